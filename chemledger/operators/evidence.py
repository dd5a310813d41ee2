"""Evidence in long form, its completeness and proof, and the section-wise draft of safety data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chemledger.functions.text import first_match, first_present, hazard_codes, month_name_date

# Statuses of a safety draft, words of section 3 that are no name or end what is none, uses and limits of section 1, and the patterns of the drafts.
NO, NO_DATA = "NO", "NO_DATA"
STATUSES = (
    "pbt_status", "vpvb_status", "endocrine_section_2_status", "carcinogenicity_status", "germ_cell_mutagenicity_status", "reproductive_toxicity_status",
    "endocrine_section_11_status", "skin_sensitization_status", "respiratory_sensitization_status",
)
NOT_NAMES = ("Nazwa produktu/", "składnika", "Identyfikatory", "%")
HEADING_END, UNCLASSIFIED = "czynniki M i ATE", "Nie sklasyfikowany"
MARKER = r"(?:REACH #|WE):"
CAS = r"CAS:\s*[0-9-]+"
CONCENTRATION = r"(?m)^(<|≤|≥)?[0-9]+(?:\.[0-9]+)?(?:\s*-\s*(?:<|≤|≥)?[0-9]+)?$"
SHEET_TITLE = "KARTA CHARAKTERYSTYKI"
USES = ("Farba lub inna podobna substancja.", "Paint or similar material.")
LIMITS = ("Jedynie do stosowania przemysłowego.", "For industrial use only.")


def flat(fields: DataFrame) -> DataFrame:
    """One row for each field and proof; a field without proof keeps one row. A ``domain_value`` that is present, null or not, stands for the value.

    ``fields``: evidence_id, field, value, domain_value, has_domain, state, evidence (array of page, section, subsection, label, source_text).
    """
    rows = fields.select("evidence_id", "field", F.when(F.col("has_domain"), F.col("domain_value")).otherwise(F.col("value")).alias("value"), "state", F.explode_outer("evidence").alias("proof"))
    context = F.array_join(F.filter(F.array("proof.section", "proof.subsection", "proof.label"), lambda x: x.isNotNull() & (x != "")), " / ")
    return rows.select("evidence_id", "field", "value", "state", F.col("proof.page").alias("page"), F.when(F.col("proof").isNotNull(), context).otherwise("").alias("context"), F.col("proof.source_text").alias("source_text"))


def provenance(chosen: Column, value: Column, domain_value: Column, has_domain: Column, state: Column) -> Column:
    """Whether a chosen value is the extracted proposal or was filled in by hand; without a choice, whether there is a proposal."""
    proposed = F.when(state == "FOUND", F.when(has_domain, domain_value).otherwise(value))
    return F.when(chosen.isNull(), F.when(proposed.isNull(), "NO_DECISION").otherwise("NO_DECISION_PROPOSED")).when(chosen.eqNullSafe(proposed), "FROM_EVIDENCE").otherwise("BY_HAND")


def header_complete(fields: DataFrame) -> DataFrame:
    """Documents whose name, date, revision and single manufacturer are found with proof, and whose code is found with proof or not there at all.

    ``fields``: evidence_id, field, state, proofs (how many). A manufacturer field is called MANUFACTURER.
    """
    proven = (F.col("state") == "FOUND") & (F.col("proofs") > 0)
    has = lambda f: F.count_if((F.col("field") == f) & proven) == 1
    code = F.count_if((F.col("field") == "product_code") & (proven | (F.col("state") == "NOT_FOUND"))) == 1
    makers = F.count_if(F.col("field") == "MANUFACTURER") == 1
    return fields.groupBy("evidence_id").agg((has("product_name") & has("issue_date") & has("revision") & makers & has("MANUFACTURER") & code).alias("complete"))


def proof_issues(proofs: DataFrame, pages: DataFrame) -> DataFrame:
    """Proofs that do not stand: a page outside the source, or a quoted line that is not on its page.

    ``proofs``: source_id, field, page_no, source_text. ``pages``: source_id, page_no, text.
    """
    met = proofs.join(pages.select("source_id", "page_no", "text"), ["source_id", "page_no"], "left")
    quoted = F.forall(F.split("source_text", r"\R"), lambda line: F.col("text").contains(F.trim(line)))
    issue = F.when(F.col("text").isNull(), "PAGE_OUTSIDE_SOURCE").when(F.coalesce(F.trim("source_text"), F.lit("")) == "", "QUOTE_EMPTY").when(~quoted, "QUOTE_NOT_ON_PAGE")
    return met.withColumn("issue", issue).where("issue is not null").select("source_id", "field", "page_no", "issue")


def role_issues(parties: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Role findings of each document: roles that do not exist, one name twice in a role (case aside), and no manufacturer. FAIL only if a role is invalid.

    ``parties``: source_id, role, name.
    """
    names = parties.where("name is not null").groupBy("source_id", "role", F.lower("name").alias("folded")).agg(F.count(F.lit(1)).alias("n"))
    twice = names.groupBy("source_id").agg(F.max(F.col("n") > 1).alias("twice"))
    own = parties.groupBy("source_id").agg(F.max(~F.col("role").isin(*allowed)).alias("invalid"), F.max(F.col("role") == "MANUFACTURER").alias("has_maker")).join(twice, "source_id", "left")
    issues = F.array_join(F.array_compact(F.array(F.when(F.col("invalid"), "INVALID_ROLE"), F.when(F.coalesce("twice", F.lit(False)), "DUPLICATE_PARTY"), F.when(~F.col("has_maker"), "MANUFACTURER_MISSING"))), ";")
    return own.select("source_id", issues.alias("issues"), F.when(F.col("invalid"), "FAIL").otherwise("PASS").alias("status"))


def section_texts(pages: DataFrame) -> DataFrame:
    """``source_id`` and the whole text of a source, page after page."""
    return pages.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n").alias("text"))


def section(text: Column, number: int) -> Column:
    """The body of a section, up to the next section's heading; empty where there is none."""
    return F.regexp_extract(text, rf"(?sm)^[ \t]*SEKCJA[ \t]+{number}[ \t]*[:.][^\n]*\n?(.*?)(?=^[ \t]*SEKCJA[ \t]+\d|\z)", 1)


def header_draft(texts: DataFrame) -> DataFrame:
    """``source_id`` and what the first lines and section 1 suggest: name, code, use, limit, issue date, revision, and PL where the sheet reads as Polish.

    ``texts``: source_id, text (of the whole source). White space around lines and blank lines are left out first. The name is the first line before the
    title, or of all where there is no title. A null or blank text suggests nothing.
    """
    lines = F.filter(F.transform(F.split("text", r"\R"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = texts.select("source_id", F.array_join(lines, "\n").alias("text"))
    t, own = F.col("text"), section(F.col("text"), 1)
    name = F.regexp_extract(F.substring_index(t, SHEET_TITLE, 1), r"^\s*([^\n]+)", 1)
    polish = t.contains(SHEET_TITLE) & t.contains("SEKCJA 1:")
    dated = r"(?iu)Data wydania/Data aktualizacji\s*:\s*([0-9]{1,2}),\s*([A-Za-ząćęłńóśźż]+),\s*([0-9]{4})"
    issued = month_name_date(F.concat_ws(" ", *[F.regexp_extract(t, dated, k) for k in (1, 2, 3)]))
    return rows.select(
        "source_id", F.when(F.trim(name) != "", F.trim(name)).alias("product_name"), first_match(own, r"(?m)^([0-9A-Za-z][0-9A-Za-z./-]{2,})$").alias("manufacturer_product_code"),
        first_present(own, *USES).alias("use_description"), first_present(own, *LIMITS).alias("use_restriction"), issued.alias("issue_date"),
        first_match(t, r"(?i)Wersja\s*:\s*([0-9]+(?:\.[0-9]+)?)").alias("revision"), F.when(polish, "PL").alias("detected_language"), F.when(polish, True).alias("language_valid"))


def safety_draft(sections: DataFrame) -> DataFrame:
    """``source_id`` and the safety profile that section 2 suggests; nine statuses are without data until they are read by hand.

    ``sections``: source_id, text (of section 2).
    """
    t = F.col("text")
    return sections.select(
        "source_id", first_match(t, r"(?iu)Definicja produktu\s*:\s*(.+)").alias("product_definition"), F.when(F.lower(t).contains("nie został sklasyfikowany"), NO).alias("hazardous_classification_status"),
        first_match(t, r"(?iu)Klasyfikacja[^\n]*:\s*(.+)").alias("clp_classification_text"), first_match(t, r"(?iu)Hasło ostrzegawcze\s*:\s*(.+)").alias("signal_word"), F.array_join(hazard_codes(t), ";").alias("hazard_statements"),
        F.lit("").alias("supplemental_hazard_statements"), *[F.lit(NO_DATA).alias(c) for c in STATUSES])


def components(sections: DataFrame) -> DataFrame:
    """One row for each CAS number of section 3: what stands before it names and identifies the component, what follows up to the next marker, be it past
    other CAS numbers, classifies it. Of a concentration with a sign in front the sign alone is kept.

    ``sections``: source_id, text (of section 3).
    """
    # cut once for each section; outer, as from a plain explode Spark infers a filter that would do it all once more
    cut = sections.select("source_id", F.split(F.concat(F.lit("\n"), "text"), rf"(?={CAS})").alias("parts"))
    parts, count = F.col("parts"), F.size("parts") - 1
    record = lambda i: F.struct(
        F.element_at(parts, i).alias("last"), F.element_at(parts, i + 1).alias("here"),
        F.regexp_extract(F.array_join(F.slice(parts, i + 1, F.size(parts)), ""), rf"(?s)^({CAS}.*?)(?:{MARKER}|\z)", 1).alias("body"))
    records = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), record))
    rows = cut.select("source_id", F.posexplode_outer(records).alias("at", "c")).where("at is not null").select("source_id", "at", "c.*")
    before = F.when(F.col("at") == 0, F.col("last")).otherwise(F.regexp_replace("last", rf"^{CAS}", ""))
    has_marker = before.rlike(MARKER)
    prefix = F.when(has_marker, F.regexp_extract(before, rf"(?s)^(.*?){MARKER}", 1)).otherwise(before)
    identifiers = F.when(has_marker, F.regexp_extract(before, rf"(?s)({MARKER}.*)$", 1)).otherwise(before)
    rows = rows.select("source_id", "at", "here", "body", identifiers.alias("identifiers"), F.filter(F.transform(F.split(prefix, r"\R"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin(*NOT_NAMES)).alias("lines"))
    after = lambda lines, n: F.slice(lines, n + 1, F.greatest(F.size(lines), F.lit(1)))
    rows = rows.withColumn("lines", after(F.col("lines"), F.greatest(F.array_position("lines", HEADING_END).cast("int"), F.lit(0))))
    # each unclassified line cuts, from what the one before it has left, as many lines as its own place among all
    cut = F.aggregate(F.transform("lines", lambda x, i: F.when(x.contains(UNCLASSIFIED), i + 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("lines", after(F.col("lines"), cut))
    name = F.trim(F.array_join(F.slice("lines", F.greatest(F.size("lines") - 2, F.lit(1)), F.lit(3)), " "))
    body, sign = F.col("body"), F.regexp_extract("body", CONCENTRATION, 1)
    marked = F.filter(F.split(body, r"\R"), lambda x: x.contains("H") | x.contains("Tox."))
    return rows.select(
        "source_id", (F.col("at") + 1).alias("ordinal"), F.when(name != "", name).alias("component_name"), F.regexp_extract("here", r"^CAS:\s*([0-9-]+)", 1).alias("cas_number"),
        first_match(F.col("identifiers"), r"(?i)WE:\s*([0-9-]+)").alias("ec_number"), first_match(F.col("identifiers"), r"(?i)REACH #:\s*([0-9-]+)").alias("reach_registration_number"),
        F.when(body.rlike(CONCENTRATION), F.when(sign != "", sign).otherwise(F.trim(F.regexp_extract("body", CONCENTRATION, 0)))).alias("concentration_text"),
        F.when(F.size(marked) > 0, F.array_join(marked, " ")).alias("classification_text"), F.array_join(hazard_codes(body), ";").alias("hazard_statements"))


def accepted_profiles(profiles: DataFrame) -> DataFrame:
    """Safety profiles as they are registered: a status that nobody has set is NO_DATA; other columns stay."""
    unset = [c for c in ("hazardous_classification_status", *STATUSES) if c in profiles.columns]
    return profiles.withColumns({c: F.coalesce(c, F.lit(NO_DATA)) for c in unset})


def accepted_components(components: DataFrame) -> DataFrame:
    """Components as they are registered: those without a name go."""
    return components.where(F.coalesce(F.trim("component_name"), F.lit("")) != "")
