"""Keyed surrogates for personal data in sheet texts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# Titles that show a gender, by language.
TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "Pan", "Господин")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Pani", "Госпожа")
# Alphabets and syllables that surrogates are made of.
ALPHABETS = {"[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[0-9]": "0123456789", r"[\p{IsCyrillic}&&\p{Ll}]": "абвгдежзиклмнопрстуфхцчшэюя", r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", r"[\p{IsGreek}&&\p{Ll}]": "αβγδεζηθικλμνξοπρστυφχψω", r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"[\p{IsLatin}&&\p{Ll}]": "àáâäçèéêëíîïñóôöùúûü", r"[\p{IsLatin}&&\p{Lu}]": "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"}
SYLLABLES = {"latin": ("ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"), "cyrillic": ("ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "ви", "зо"), "greek": ("βα", "δε", "φι", "γο", "χα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "βε", "ψι", "ζο")}
ENDINGS = {"latin": ("n", "la"), "cyrillic": ("н", "ла"), "greek": ("ς", "λα")}

_before, _after = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_title = "|".join(sorted(TITLES_M + TITLES_F, key=len, reverse=True))
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}.\-]+\.\p{L}{2,}"
SECRET = _before + r"[0-9a-fA-F]{32,}+" + _after
IBAN = _before + r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}+" + _after
PERSON = _before + rf"(?:{_title})\.? \p{{Lu}}\p{{Ll}}{{1,30}}+(?: \p{{Lu}}\p{{Ll}}{{1,30}}+)?" + _after
PHONE = r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,3}" + _after + "|" + _before + r"\(\d{3}\) ?\d{3}-\d{4}" + _after + "|" + _before + r"\d{3}[.\-]\d{3}[.\-]\d{4}" + _after
NATIONAL_ID = _before + r"\d{3}-\d{2}-\d{4}" + _after
CARD = _before + r"\d{13,19}+" + _after + "|" + _before + r"\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}" + _after
IP = r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IBAN, PERSON, PHONE, NATIONAL_ID, CARD, IP))
HINT = rf"[0-9@]|(?:{_title})\.? "
DIGIT_KINDS = ("PHONE", "CARD", "NATIONAL_ID")
MAX_ATTEMPTS = 64


def kind(mention: Column) -> Column:
    """What an entity is, told by its own text."""
    return (
        F.when(mention.contains("@"), "EMAIL").when(mention.rlike("^[0-9a-fA-F]{32,}$"), "SECRET").when(mention.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11}"), "IBAN")
        .when(mention.rlike(f"^(?:{'|'.join(TITLES_F)})[. ]"), "PERSON_F").when(mention.rlike(f"^(?:{'|'.join(TITLES_M)})[. ]"), "PERSON_M")
        .when(mention.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "IP").when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "NATIONAL_ID").when(mention.rlike(r"^\d[\d \-]{12,}$"), "CARD").otherwise("PHONE")
    )


def canonical(mention: Column) -> Column:
    """The form that all mentions of one entity share: digits only, the name without its title, or lower case."""
    k = kind(mention)
    return F.when(k.isin(*DIGIT_KINDS), F.regexp_replace(mention, "[^0-9]", "")).when(k.startswith("PERSON"), F.regexp_replace(mention, rf"^\p{{L}}+\.? ", "")).when(k == "IBAN", mention).otherwise(F.lower(mention))


def _stream(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits that depend on the key and the parts."""
    said = F.concat_ws("\u0001", F.lit(key), *[p.cast("string") for p in parts])
    return F.concat(F.sha2(said, 256), F.sha2(F.concat(said, F.lit("+")), 256))


def _value(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _substituted(text: Column, stream: Column, alphabets: dict[str, str]) -> Column:
    """Each character replaced by one of its own class; characters of no class stay."""

    def one(i: Column) -> Column:
        c, out = F.substring(text, i + 1, F.lit(1)), None
        for pattern, letters in alphabets.items():
            new = F.substring(F.lit(letters), _value(stream, i) % len(letters) + 1, F.lit(1))
            out = F.when(c.rlike(f"^{pattern}$"), new) if out is None else out.when(c.rlike(f"^{pattern}$"), new)
        return out.otherwise(c)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.length(text) - 1), one), ""))


def _luhn(digits: Column) -> Column:
    """The check sum of a digit string modulo 10 (0: valid)."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10


def _name(word: Column, gender: Column, key: str, attempt: Column, given: Column) -> Column:
    """A made-up name in the word's script; given names end by gender; every further attempt is one syllable longer."""
    out = None
    for script, syllables in SYLLABLES.items():
        stream = _stream(key, F.lit("name"), F.when(given, gender).otherwise(F.lit("")), F.lower(word), attempt)
        part = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: F.element_at(F.array(*map(F.lit, syllables)), _value(stream, i) % len(syllables) + 1)), "")
        end = F.when(given & (gender == "PERSON_F"), ENDINGS[script][1]).when(given, ENDINGS[script][0]).otherwise("")
        made = F.initcap(F.concat(part, end))
        test = {"latin": None, "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}[script]
        out = made if test is None else F.when(word.rlike(test), made).otherwise(out)
    return out


def drawn(kind_: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The surrogate that the key gives an entity at an attempt, in canonical form."""
    s = _stream(key, kind_, entity, attempt)
    digits = F.concat(F.substring(entity, F.lit(1), F.lit(1)), _substituted(F.substring(entity, F.lit(2), F.length(entity)), s, {"[0-9]": ALPHABETS["[0-9]"]}))
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    checked = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    card = F.when(_luhn(entity) == 0, checked).otherwise(digits)
    octet = lambda n: F.conv(F.substring(s, F.lit(8 * n + 1), F.lit(8)), 16, 10).cast("long")
    ip = F.concat_ws(".", *[(octet(n) % (223 if n == 0 else 254) + 1).cast("string") for n in range(4)])
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    host, top = F.regexp_replace(domain, r"\.[^.]*$", ""), F.substring_index(domain, ".", -1)
    longer = F.when(attempt > 0, F.translate(attempt.cast("string"), "0123456789", "abcdefghij")).otherwise("")
    email = F.concat(_substituted(local, s, ALPHABETS), longer, F.lit("@"), _substituted(host, _stream(key, F.lit("host"), host), ALPHABETS), F.lit("."), top)
    first, second = F.substring_index(entity, " ", 1), F.substring_index(entity, " ", -1)
    both = entity.contains(" ")
    person = F.when(both, F.concat_ws(" ", _name(first, kind_, key, attempt, F.lit(True)), _name(second, kind_, key, attempt, F.lit(False)))).otherwise(_name(second, kind_, key, attempt, F.lit(False)))
    return (
        F.when(kind_ == "CARD", card).when(kind_.isin(*DIGIT_KINDS), digits).when(kind_ == "IP", ip).when(kind_ == "EMAIL", email).when(kind_.startswith("PERSON"), person)
        .when(kind_ == "SECRET", _substituted(entity, s, {"[0-9a-f]": "0123456789abcdef"})).otherwise(F.concat(F.substring(entity, F.lit(1), F.lit(2)), _substituted(F.substring(entity, F.lit(3), F.length(entity)), s, ALPHABETS)))
    )


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """One surrogate for each distinct (kind, entity), with no two alike within a kind and none that is itself an entity of the corpus.

    All entities draw; of those that drew alike the first keeps its draw, and the others, with those that hit an entity, draw again against all kept
    draws until none is left. Every round works on the rest of the round before, which is far smaller.
    """
    entities = common.written(entities.select("kind", "entity").distinct(), "entities")
    names = entities.select("kind", F.col("entity").alias("surrogate"))
    rest, kept = entities, []
    for attempt in range(MAX_ATTEMPTS):
        draws = rest.withColumn("surrogate", drawn(F.col("kind"), F.col("entity"), F.lit(attempt), key))
        free = draws.join(names, ["kind", "surrogate"], "left_anti")
        for done in kept:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("entity"))
        kept.append(common.written(free.withColumn("nth", first).where("nth = 1").select("kind", "entity", "surrogate"), "surrogates"))
        rest = common.written(rest.join(kept[-1].select("kind", "entity"), ["kind", "entity"], "left_anti"), "colliding")
        if rest.isEmpty():
            break
    else:
        raise ValueError("no distinct surrogates left for some entities")
    out = kept[0]
    for done in kept[1:]:
        out = out.unionByName(done)
    return out


def _rendered(mention: Column, surrogate: Column) -> Column:
    """A surrogate written as the mention is: its digit groups, its title, its capitals."""
    k = kind(mention)
    before = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^0-9]", ""))
    digit = lambda i: F.when(F.substring(mention, i + 1, F.lit(1)).rlike("[0-9]"), F.substring(surrogate, before(i), F.lit(1))).otherwise(F.substring(mention, i + 1, F.lit(1)))
    return (
        F.when(k.isin(*DIGIT_KINDS), F.array_join(F.transform(F.sequence(F.lit(0), F.length(mention) - 1), digit), ""))
        .when(k.startswith("PERSON"), F.concat(F.regexp_extract(mention, r"^\p{L}+\.? ", 0), surrogate))
        .when((k != "IP") & (k != "IBAN") & (mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(surrogate)).otherwise(surrogate)
    )


def surrogate_sds(sds: DataFrame, key: str, keep: str | None = None) -> DataFrame:
    """Replace personal data in every sheet's whole text: ``sds_id``, ``text``, ``n_entities`` (mentions replaced), and ``keep``, a column passed through.

    ``sds``: sds_id, text string. Entities: e-mail and IP addresses, phone, card, national and bank account numbers, hexadecimal secrets, and names after
    a title that shows a gender. Mentions of one entity get one surrogate throughout the corpus, whatever their format (coreference), and different
    entities of a kind get different ones (distinctness), none of which is an entity of the corpus. A surrogate keeps the format, the script of its
    letters, the title's gender, and the check digit of cards that have a valid one. The same key gives the same surrogates for the same corpus.

    Null and empty texts stay as they are with n_entities 0. Repeated rows stay. Columns other than ``keep`` are ignored. No rows in, no rows out.
    Texts without entities never move; the others meet their surrogates by the hash of their text, so copies of one text are looked up once.
    """
    own = sds.select("sds_id", "text", *([F.col(keep).alias("kept")] if keep else []))
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    marked = own.withColumn("mentions", found)
    has = F.coalesce(F.size("mentions") > 0, F.lit(False))
    clean = marked.where(~has).select(*own.columns, F.lit(0).cast("long").alias("n_entities"))
    dirty = marked.where(has).withColumn("text_key", F.sha2("text", 256))
    pairs = common.written(dirty.select("text_key", F.explode(F.array_distinct("mentions")).alias("mention")).distinct().withColumn("kind", kind(F.col("mention"))).withColumn("entity", canonical(F.col("mention"))), "mentions")
    chosen = pairs.select("mention", "kind", "entity").distinct().join(surrogate_table(pairs, key), ["kind", "entity"]).select("mention", _rendered(F.col("mention"), F.col("surrogate")).alias("to"))
    per_text = pairs.select("text_key", "mention").join(chosen, "mention").groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("mention", "to"))).alias("to"))
    parts, new = F.split("text", ANY, -1), F.transform("mentions", lambda m: F.element_at("to", m))
    woven = F.concat(F.element_at(parts, 1), F.array_join(F.zip_with(new, F.slice(parts, 2, F.size(parts)), lambda a, b: F.concat(a, b)), ""))
    replaced = dirty.join(per_text, "text_key").select("sds_id", woven.alias("text"), *(["kept"] if keep else []), F.size("mentions").cast("long").alias("n_entities"))
    out = clean.unionByName(replaced)
    return out.withColumnRenamed("kept", keep) if keep else out


def op9_surrogates(spark: SparkSession, sf_dir: str, key: str = "sheet-surrogates-1") -> DataFrame:
    """Every whole text of ``documents`` with its personal data replaced."""
    return surrogate_sds(common.sds_texts(common.table(spark, sf_dir, "documents")), key).withColumnRenamed("sds_id", "doc_id")
