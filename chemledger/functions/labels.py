"""Display text built from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display words of the registry.
DASH = "—"
STATUS_WORDS = {"ACTIVE": "Aktywny", "PENDING_APPROVAL": "Oczekuje na BHP", "REJECTED": "Odrzucony",
                "INACTIVE": "Nieaktywny"}
CATEGORY_WORDS = {"APPROVED": "Dopuszczony", "REJECTED": "Odrzucony", "NO_DECISION": "Brak decyzji",
                  "NOT_APPLICABLE_NO_CURRENT_SDS": "Brak CURRENT SDS"}
WITHDRAWN_STATUS = "🔴 ⚠️ Brak bieżącego SDS — wycofano bieżący dokument"
WITHDRAWN_DOCUMENT = "🔴 ⚠️ Wycofany / błędna rejestracja"
DECISION_WORDS = {"APPROVED": "Zatwierdzona", "REJECTED": "Odrzucona"}


def words(column: Column, table: dict[str, str], otherwise: Column) -> Column:
    out = None
    for key, word in table.items():
        out = F.when(column == key, word) if out is None else out.when(column == key, word)
    return out.otherwise(otherwise)


def or_dash(column: Column) -> Column:
    return F.when(column.isNull() | (column == ""), DASH).otherwise(column)


def folded(column: Column) -> Column:
    """Lower case with the sharp s written out, as Python's casefold has it."""
    return F.replace(F.lower(column), F.lit("ß"), F.lit("ss"))


def plain_decimal(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def quantity(value: Column, unit: Column) -> Column:
    return F.when(value.isNull(), DASH).otherwise(F.trim(F.concat(plain_decimal(value), F.lit(" "), F.coalesce(unit, F.lit("")))))


def difference(value: Column, unit: Column) -> Column:
    return F.when(value.isNull(), DASH).otherwise(F.concat(F.when(value > 0, "+").otherwise(""), quantity(value, unit)))


def revision_detail(revision: Column, issue_date: Column) -> Column:
    text = F.concat_ws(" · ", F.when(revision != "", F.concat(F.lit("Rewizja "), revision)), issue_date.cast("string"))
    return F.when(text == "", DASH).otherwise(text)


def document_state(current_sds_id: Column, available: Column, withdrawn: Column) -> Column:
    return (F.when(withdrawn, WITHDRAWN_DOCUMENT).when(current_sds_id.isNull(), "Brak CURRENT SDS")
            .when(available, "CURRENT").otherwise("Brak pliku SDS"))
