"""Scalar functions over text, dates and file names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Evidence types by suffix, and Polish month names without diacritics, in both grammatical cases, and the one short form.
EVIDENCE_TYPES = {".msg": "EMAIL", ".pdf": "DOCUMENT", ".jpg": "PHOTO_SCAN", ".jpeg": "PHOTO_SCAN", ".png": "PHOTO_SCAN"}
MONTHS = (
    ("stycznia", "styczen"), ("lutego", "luty"), ("marca", "marzec"), ("kwietnia", "kwiecien"), ("maja", "maj"), ("czerwca", "czerwiec", "cze"),
    ("lipca", "lipiec"), ("sierpnia", "sierpien"), ("wrzesnia", "wrzesien"), ("pazdziernika", "pazdziernik"), ("listopada", "listopad"), ("grudnia", "grudzien"),
)
DIACRITICS, PLAIN = "ąćęłńóśźż", "acelnoszz"


def location_code(value: Column) -> Column:
    """Stripped, upper case, or null where it is no code."""
    code = F.upper(F.trim(value))
    return F.when(code.rlike("^[A-Z0-9][A-Z0-9_-]{0,31}$"), code)


def normal_name(value: Column) -> Column:
    """Case folded, white space collapsed."""
    return F.replace(F.lower(F.trim(F.regexp_replace(value, r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def strict_date(value: Column, shape: str, pattern: str) -> Column:
    """A date of exactly this shape; an impossible one is null."""
    return F.when(value.rlike(f"^(?:{shape})$"), F.try_to_date(value, pattern))


def iso_date(value: Column) -> Column:
    return strict_date(value, r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd")


def slash_iso_date(value: Column) -> Column:
    return strict_date(value, r"\d{4}/\d{2}/\d{2}", "yyyy/MM/dd")


def dotted_date(value: Column) -> Column:
    return strict_date(value, r"\d{2}\.\d{2}\.\d{4}", "dd.MM.yyyy")


def slash_date(value: Column) -> Column:
    return strict_date(value, r"\d{2}/\d{2}/\d{4}", "dd/MM/yyyy")


def month_number(word: Column) -> Column:
    """1 to 12 for a Polish month name, with or without diacritics and a trailing point."""
    name = F.regexp_replace(F.translate(F.lower(word), DIACRITICS, PLAIN), r"\.$", "")
    out = F.when(name.isin(*MONTHS[0]), 1)
    for k, names in enumerate(MONTHS[1:], 2):
        out = out.when(name.isin(*names), k)
    return out


def month_name_date(value: Column) -> Column:
    """``7 maja 2021`` as a date."""
    shape = r"^(\d{1,2})\s+(\p{L}+\.?)\s+(\d{4})$"
    day, word, year = (F.regexp_extract(value, shape, k) for k in (1, 2, 3))
    return F.when(value.rlike(shape), F.try_to_date(F.concat_ws("-", year, F.lpad(month_number(word).cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))


def ambiguous_slash_date(value: Column, previous: Column) -> Column:
    """``a/b/yyyy``: day before month unless only the other reading is a date; where both are, a neighbouring earlier date with a part over 12 settles it."""
    day_first, month_first = F.try_to_date(value, "d/M/yyyy"), F.try_to_date(value, "M/d/yyyy")
    shape = value.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    american = F.try_to_date(previous, "d/M/yyyy").isNull() & F.try_to_date(previous, "M/d/yyyy").isNotNull()
    return F.when(shape & day_first.isNull(), month_first).when(shape & month_first.isNotNull() & F.coalesce(american, F.lit(False)), month_first).when(shape, day_first)


def version_token(value: Column) -> Column:
    """A version as written; leading zeros count."""
    return F.when(value.rlike(r"^\d+(\.\d+)?(/PL)?$"), value)


def without_marks(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, "[®™]", ""))


def hazard_codes(value: Column) -> Column:
    """H codes of three digits in the order first seen; lettered codes are not among them."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(r"\bH[0-9]{3}\b"), F.lit(0)))


def first_match(value: Column, pattern: str) -> Column:
    """The first capture, or null without a match."""
    return F.when(value.rlike(pattern), F.trim(F.regexp_extract(value, pattern, 1)))


def first_present(value: Column, *literals: str) -> Column:
    return F.coalesce(*[F.when(value.contains(x), F.lit(x)) for x in literals])


def evidence_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = None
    for k, v in EVIDENCE_TYPES.items():
        out = F.when(suffix == k, v) if out is None else out.when(suffix == k, v)
    return out


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def plain_file_name(value: Column) -> Column:
    return F.coalesce((value != "") & ~value.isin(".", "..") & ~value.rlike(r"[/\\:]") & ~value.contains("\u0000"), F.lit(False))


def quantity(value: Column) -> Column:
    """A stripped decimal of zero or more; blank and anything else is null."""
    parsed = F.trim(value).try_cast("decimal(18,6)")
    return F.when(parsed >= 0, parsed)


def entries(value: Column) -> Column:
    """The trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(value, r"\R"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
