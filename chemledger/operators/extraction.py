"""Field extraction from page text, line by line: pages, logical documents, sections, rule hits, field states."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chemledger.functions import text as fn

# Section and subsection headings, the identification phrase, and the rule catalogue.
SECTION = r"^[ \t]*[*-]?[ \t]*(?:SEKCJA|SECTION)[ \t]+(\d{1,2})[ \t]*[:.](?!\d)"
ENGLISH_SECTION = r"^[ \t]*[*-]?[ \t]*SECTION[ \t]"
SUBSECTION = r"^[ \t]*-?[ \t]*(1\.[1-4]|11\.1)\.?[ \t]+"
MAY_BE_HEADING = r"^[ \t]*[*-]?[ \t]*(?:SE|1)"  # how headings of sections and subsections begin
IDENTIFICATION = r"(?iU)IDENTYFIKACJA\s+SUBSTANCJI/MIESZANINY\s+I\s+IDENTYFIKACJA\s+PRZEDSIĘBIORSTWA"
SECTION_1_2 = r"^\s*1\.2\.?\s+"
HEADER_LINES, FOOTER_LINES = 30, 16


@dataclass(frozen=True)
class Rule:
    """One catalogue rule: what to look for, where, and how to read the value."""

    alias_id: str
    label: str
    field: str
    role: str
    contexts: tuple[str, ...]
    binding: str
    status: str = "ACTIVE"


RULES = (
    Rule("A-001", "Nazwa produktu", "product_name", "PRODUCT_NAME", ("1.1",), "same_line"),
    Rule("A-002", "Kod produktu", "product_code", "PRODUCT_CODE", ("1.1",), "same_line"),
    Rule("A-003", "Mfg. in U.S.A and exported by", "party", "MANUFACTURER_EXPORTER", ("1.3",), "next_line"),
    Rule("A-004", "EU Only Representative", "party", "EU_REPRESENTATIVE", ("1.3",), "same_line"),
    Rule("A-005", "Data wydania/Data aktualizacji", "issue_date", "SDS_ISSUE_OR_UPDATE_DATE", ("FOOTER",), "polish_current_date"),
    Rule("A-006", "Wersja", "revision", "SDS_REVISION", ("HEADER", "FOOTER"), "version"),
    Rule("A-007", "Nazwa wyrobu", "product_name", "PRODUCT_NAME", ("1.1",), "same_line"),
    Rule("A-008", "Aktualizacja", "issue_date", "SDS_ISSUE_OR_UPDATE_DATE", ("HEADER",), "iso_slash_date"),
    Rule("A-009", "IDENTYFIKACJA FIRMY", "party", "SUPPLIER", ("1.3",), "supplier_next_line"),
    Rule("A-011", "Data aktualizacji", "issue_date", "SDS_ISSUE_OR_UPDATE_DATE", ("HEADER",), "dmy_current_date"),
    Rule("A-012", "Numer wersji", "revision", "SDS_REVISION", ("HEADER",), "version"),
)


def pattern_of(r: Rule) -> str:
    label = r"\s+".join("\\Q" + w + "\\E" for w in r.label.split())
    return rf"(?iU)(?<!\w){label}" + (r"\s*$" if r.binding == "supplier_next_line" else r"\s*:\s*(.*)")


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ACTIVE rules, a row for each rule and context; a catalogue, whatever the number of pages."""
    rows = [(r.alias_id, r.label, r.field, r.role, c, r.binding, pattern_of(r)) for r in rules if r.status == "ACTIVE" for c in r.contexts]
    return spark.createDataFrame(rows, "alias_id string, label string, field string, role string, context string, binding string, pattern string")


def folded(text: Column) -> Column:
    """Lower case, with the other letters that a pattern without regard to case takes for ASCII ones."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.lower(F.translate(text, "ſıİ", "sii")))


def page_lines(pages: DataFrame) -> DataFrame:
    """``source_id``, ``page_no``, ``line_no``, ``line``, ``blank`` and ``indent``."""
    # from a plain explode Spark infers a filter that would split every page once more
    rows = pages.select("source_id", "page_no", F.posexplode_outer(F.split("text", r"\R")).alias("line_no", "line")).where("line_no is not null")
    return rows.withColumns({"blank": F.trim(F.col("line")) == "", "indent": F.length("line") - F.length(F.ltrim(F.col("line")))})


def readability(pages: DataFrame) -> DataFrame:
    """READABLE if every page of a source has text, PARTIALLY_READABLE if some have, UNREADABLE if none."""
    full = F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "")
    return pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("pages"), F.when(full == F.count(F.lit(1)), "READABLE").when(full > 0, "PARTIALLY_READABLE").otherwise("UNREADABLE").alias("readability_status"))


def _found(value: Column, pattern: str) -> Column:
    return F.when(value.rlike(MAY_BE_HEADING) & value.rlike(pattern), F.regexp_extract(value, pattern, 1))


def labelled_lines(pages: DataFrame) -> DataFrame:
    """Lines with their section, heading block, and the subsection (1.1 or 1.3) whose first qualifying block they are in.

    A heading qualifies inside section 1, or before any section once the identification phrase (or, for 1.3, a 1.2 heading) has come; 11.1 is read as 1.1.
    All windows run inside one page.
    """
    page = Window.partitionBy("source_id", "page_no").orderBy("line_no")
    upto, before = page.rowsBetween(Window.unboundedPreceding, 0), page.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source_id", "page_no")
    rows = page_lines(pages).withColumns({"own_section": _found(F.col("line"), SECTION), "own_sub": _found(F.col("line"), SUBSECTION)})
    rows = rows.withColumns({
        "section": F.last("own_section", ignorenulls=True).over(upto),
        "identified": F.coalesce(F.max(F.col("line").rlike(IDENTIFICATION)).over(before), F.lit(False)),
        "after_1_2": F.coalesce(F.max(F.col("line").rlike(SECTION_1_2)).over(before), F.lit(False)),
        "block": F.count(F.when(F.col("own_section").isNotNull() | F.col("own_sub").isNotNull(), 1)).over(upto),
        "first_section": F.min(F.when(F.col("own_section").isNotNull(), F.col("line_no"))).over(whole),
        "last_line": F.max(F.when(~F.col("blank"), F.col("line_no"))).over(whole),
    })
    inside, outside = F.col("section") == "1", F.col("section").isNull()
    opens_11 = F.col("own_sub").isin("1.1", "11.1") & (inside | (outside & F.col("identified")))
    opens_13 = (F.col("own_sub") == "1.3") & (inside | (outside & (F.col("identified") | F.col("after_1_2"))))
    for name, opens in (("block_11", opens_11), ("block_13", opens_13)):
        rows = rows.withColumn(name, F.min(F.when(F.coalesce(opens, F.lit(False)), F.col("block"))).over(whole))
    return rows.withColumn("subsection", F.when(F.col("block") == F.col("block_11"), "1.1").when(F.col("block") == F.col("block_13"), "1.3"))


def segments(labelled: DataFrame) -> DataFrame:
    """``source_id``, ``page_no`` and the number of the logical document: page 1 starts one, and so does each later page with a heading of section 1 (in English only with a 1.1 beside it)."""
    starts = labelled.groupBy("source_id", "page_no").agg(
        F.max((F.col("own_section") == "1") & ~F.col("line").rlike(ENGLISH_SECTION)).alias("polish"), F.max((F.col("own_section") == "1") & F.col("line").rlike(ENGLISH_SECTION)).alias("english"), F.max(F.col("subsection") == "1.1").alias("has_11"))
    flag = (F.col("page_no") == 1) | F.coalesce("polish", F.lit(False)) | (F.coalesce("english", F.lit(False)) & F.coalesce("has_11", F.lit(False)))
    source = Window.partitionBy("source_id").orderBy("page_no")
    rows = starts.select("source_id", "page_no", F.sum(flag.cast("int")).over(source.rowsBetween(Window.unboundedPreceding, 0)).alias("document_no"))
    own = Window.partitionBy("source_id", "document_no")
    return rows.withColumns({"page_from": F.min("page_no").over(own), "page_to": F.max("page_no").over(own)})


def context_lines(labelled: DataFrame) -> DataFrame:
    """Non-blank lines with each context they are in: 1.1, 1.3, HEADER (before the first section, else the first lines) and FOOTER (the last lines). Adds the next line of the context."""
    header = F.coalesce(F.col("line_no") < F.col("first_section"), F.col("line_no") < HEADER_LINES)
    footer = F.col("line_no") > F.col("last_line") - FOOTER_LINES
    contexts = F.array_compact(F.array(F.col("subsection"), F.when(header, "HEADER"), F.when(footer, "FOOTER")))
    rows = labelled.where(~F.col("blank")).select("source_id", "page_no", "line_no", F.trim("line").alias("line"), F.explode(contexts).alias("context"))
    return rows.withColumn("next_line", F.lead("line").over(Window.partitionBy("source_id", "page_no", "context").orderBy("line_no")))


def reads(binding: str, raw: Column) -> Column:
    """What one binding reads from the text after the label; null where it reads nothing."""
    token = lambda shape: F.when(raw.rlike(rf"^{shape}(?=\s|$)"), F.regexp_extract(raw, rf"^({shape})", 1))
    day = lambda d: d.cast("string")
    if binding == "version":
        return token(r"[0-9]+(?:\.[0-9]+)?(?:/PL)?")
    if binding == "iso_slash_date":
        dotted = F.when(raw.rlike(r"^\d{2}\.\d{2}\.\d{4}(?:Wersja\s+\d+(?:\.\d+)?)?$"), fn.dotted_date(F.substring(raw, F.lit(1), F.lit(10))))
        return day(F.coalesce(fn.slash_iso_date(raw), dotted))
    if binding == "dmy_current_date":
        return day(F.coalesce(fn.iso_date(token(r"\d{4}-\d{2}-\d{2}")), fn.dotted_date(token(r"\d{2}\.\d{2}\.\d{4}")), fn.slash_date(token(r"\d{2}/\d{2}/\d{4}"))))
    if binding == "polish_current_date":
        current = F.trim(F.split(raw, r"(?iU)\s+Data poprzedniego\b", 2).getItem(0))
        previous = F.when(raw.rlike(r"(?iU)\bData poprzedniego"), F.regexp_extract(raw, r"(?iU)\bData poprzedniego(?: wydania)?\s*:\s*(\d{1,2}/\d{1,2}/\d{4})", 1))
        named = F.when(current.rlike(r"^\d{1,2},\s*\p{L}+,\s*\d{4}$"), fn.month_name_date(F.regexp_replace(current, r",\s*", " ")))
        return day(F.coalesce(named, fn.ambiguous_slash_date(current, previous)))
    return F.when(raw != "", raw)


def bound_value(binding: Column, raw: Column) -> Column:
    """``reads`` for a binding that differs from row to row."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in ("version", "iso_slash_date", "dmy_current_date", "polish_current_date"):
        out = out.when(binding == name, reads(name, raw))
    return out.otherwise(reads("same_line", raw))


def _by_pattern(known: Callable[[str], Column], any_: Column) -> Column:
    """``known`` for the patterns of the catalogue, each compiled once, and ``any_`` for rows with other patterns: one that differs from row to row is compiled for each."""
    return reduce(lambda rest, p: F.when(F.col("pattern") == p, known(p)).otherwise(rest), sorted({pattern_of(r) for r in RULES}), any_)


def rule_hits(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates of every rule in its contexts: ``value``, ``raw`` and the quoted ``source_text``. The catalogue is broadcast; it has a fixed number of rows."""
    # few lines hold the first word of a label, which its pattern quotes
    word = F.split("label", r"\s+").getItem(0)
    needle = F.when(F.contains("pattern", F.concat(F.lit("\\Q"), word, F.lit("\\E"))), folded(word)).otherwise("")
    named = F.broadcast(rules.withColumn("needle", needle))
    met = lines.withColumn("low", folded(F.col("line"))).join(named, "context").where(F.contains("low", F.col("needle")) & _by_pattern(lambda p: F.col("line").rlike(p), F.expr("line RLIKE pattern")))
    with_next = F.col("binding").isin("next_line", "supplier_next_line")
    stop = F.col("next_line").isNull() | F.col("next_line").rlike(r"(?iU)^(?:\d|(?:SEKCJA|Phone|Numer telefonu)\b)")
    raw = F.when(with_next, F.when(stop, "").otherwise(F.col("next_line"))).otherwise(F.trim(_by_pattern(lambda p: F.regexp_extract("line", p, 1) if "(.*)" in p else F.lit(""), F.expr("regexp_extract(line, pattern, 1)"))))
    rows = met.withColumn("raw", raw).where(~((F.col("alias_id") == "A-008") & F.col("line").rlike(r"(?iU)\bData\s+Aktualizacja"))).where(~((F.col("alias_id") == "A-011") & (F.col("raw") == "-")))
    quote = F.when(with_next, F.concat_ws("\n", "line", "next_line")).otherwise(F.col("line"))
    return rows.select("source_id", "page_no", "context", "alias_id", "label", "field", "role", "binding", "line_no", "raw", bound_value(F.col("binding"), F.col("raw")).alias("value"), quote.alias("source_text"))


def page_results(hits: DataFrame) -> DataFrame:
    """One result for each page, rule and context. No value first, or several that differ (for versions: any that differ), is AMBIGUOUS; a replacement character makes it UNREADABLE."""
    own = hits.groupBy("source_id", "page_no", "alias_id", "context", "field", "role", "binding", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("kinds"), F.count("value").alias("values"), F.min_by(F.struct("value"), "line_no")["value"].alias("first_value"),
        F.max_by(F.struct("value", "raw", "source_text"), "line_no").alias("last"))
    repeats = (F.col("n") > 1) & ((F.col("binding") != "version") | (F.col("kinds") > 1) | (F.col("values") < F.col("n")))
    state = F.when(F.col("first_value").isNull() | repeats, "AMBIGUOUS").when(F.col("last.raw").contains("�"), "UNREADABLE").otherwise("FOUND")
    return own.select("source_id", "page_no", "alias_id", "context", "field", "role", "label", state.alias("state"), F.when(state == "FOUND", F.col("last.value")).alias("value"), F.when(state == "FOUND", F.col("last.source_text")).alias("source_text"))


def _combined(rows: DataFrame, keys: list[str], order: str, found_first: bool) -> DataFrame:
    """AMBIGUOUS wins, or several values; then UNREADABLE over FOUND, or the other way round with ``found_first``."""
    any_ = lambda s: F.bool_or(F.col("state") == s)
    ambiguous = any_("AMBIGUOUS") | (F.count_distinct(F.when(F.col("state") == "FOUND", F.col("value"))) > 1)
    second, third = ("FOUND", "UNREADABLE") if found_first else ("UNREADABLE", "FOUND")
    state = F.when(ambiguous, "AMBIGUOUS").when(any_(second), second).when(any_(third), third).otherwise("NOT_FOUND")
    return rows.groupBy(*keys).agg(state.alias("state"), F.min_by(F.struct("value"), F.when(F.col("state") == "FOUND", F.col(order)))["value"].alias("value"), F.min("alias_id").alias("alias_id")).withColumn("value", F.when(F.col("state") == "FOUND", F.col("value")))


def rule_states(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Results combined over the pages of a logical document; header and footer rules count on its first and last page only."""
    rows = results.join(pages, ["source_id", "page_no"]).where(F.col("context").isin("1.1", "1.3") | F.col("page_no").isin(F.col("page_from"), F.col("page_to")))
    return _combined(rows.withColumn("rule", F.col("alias_id")), ["source_id", "document_no", "rule", "field", "role"], "page_no", found_first=False)


def field_states(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``source_id``, ``document_key``, ``field``, ``state``, ``value`` for every logical document and field; parties by role."""
    labelled = labelled_lines(pages)
    # a short row for each page, kept by the executors for its two uses, as finding it reads every line
    parts = segments(labelled).localCheckpoint(eager=False)
    states = rule_states(page_results(rule_hits(context_lines(labelled), rules)), parts)
    named = states.withColumn("field", F.when(F.col("field") == "party", F.col("role")).otherwise(F.col("field")))
    fields = _combined(named, ["source_id", "document_no", "field"], "rule", found_first=True)
    names = rules.select(F.when(F.col("field") == "party", F.col("role")).otherwise(F.col("field")).alias("field")).distinct()
    every = parts.select("source_id", "document_no").distinct().crossJoin(F.broadcast(names))
    rows = every.join(fields, ["source_id", "document_no", "field"], "left")
    return rows.select("source_id", F.format_string("DOC-%03d", F.col("document_no").cast("int")).alias("document_key"), "field", F.coalesce("state", F.lit("NOT_FOUND")).alias("state"), "value")


def documents(states: DataFrame) -> DataFrame:
    """One wide row for each logical document: the four header fields with their states, and how many parties were found."""
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    fields = ("product_name", "product_code", "issue_date", "revision")
    return states.groupBy("source_id", "document_key").agg(
        *[pick(f, c).alias(f if c == "value" else f"{f}_state") for f in fields for c in ("value", "state")],
        F.count_if(~F.col("field").isin(*fields) & (F.col("state") == "FOUND")).alias("parties"))


def source_language(pages: DataFrame) -> DataFrame:
    """pl, en or und, told by the first page."""
    t = F.col("text")
    polish = t.rlike(r"(?iU)karta charakterystyki|\bSEKCJA\b")
    english = t.rlike(r"(?iU)safety data sheet|\bSECTION\b")
    return pages.where("page_no = 1").select("source_id", F.when(polish, "pl").when(english, "en").otherwise("und").alias("language"))
