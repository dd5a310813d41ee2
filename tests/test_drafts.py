"""Drafts of a sheet's header, safety profile and components, on texts that the bindings do not hold."""

from __future__ import annotations

import pytest

from chemledger.operators import evidence


@pytest.mark.parametrize(("text", "expected"), [
    (None, []),
    ("", []),
    ("Alfa\nWE: 1-1", []),
    ("CAS: 1-1-1", [(None, "1-1-1", None, None, None, "")]),
    ("Alfa\nNie sklasyfikowany\nBeta\nGamma\nNie sklasyfikowany\nDelta\nEpsilon\nZeta\nEta\nTheta\nJota\nKappa\nLambda\nMi\nCAS: 7-7-7\n5", [("Kappa Lambda Mi", "7-7-7", None, "5", None, "")]),
    ("A\nNie sklasyfikowany\nB\nNie sklasyfikowany\nC\nCAS: 7-7-7", [(None, "7-7-7", None, None, None, "")]),
    ("X\nczynniki M i ATE\nY\nWE: 200-1\nREACH #: 01-2\nCAS: 1-2-3\n≤ 5\n0.5 - <10\nSkin Irrit. H315 (H319)\nWE: 9", [("Y", "1-2-3", "200-1", "0.5 - <10", "Skin Irrit. H315 (H319)", "H315;H319")]),
    ("Y\nCAS: \nCAS: 4-4\n<1", [("Y CAS:", "4-4", None, "<", None, "")]),
])
def test_components(spark, text, expected):
    df = spark.createDataFrame([(1, text)], "source_id long, text string")
    rows = evidence.components(df).orderBy("ordinal").collect()
    assert [(r.component_name, r.cas_number, r.ec_number, r.concentration_text, r.classification_text, r.hazard_statements) for r in rows] == expected


def test_header(spark):
    texts = [(1, None), (2, " \n "), (3, "Klej\nKARTA CHARAKTERYSTYKI\nSEKCJA 1: X\nab\nA1.\nwersja: 3"), (4, "KARTA CHARAKTERYSTYKI\nData wydania/Data aktualizacji: 30, lutego, 2020\nSEKCJA 2: X\nABC")]
    rows = {r.source_id: r for r in evidence.header_draft(spark.createDataFrame(texts, "source_id long, text string")).collect()}
    assert all(v is None for k in (1, 2) for n, v in rows[k].asDict().items() if n != "source_id")
    assert (rows[3].product_name, rows[3].manufacturer_product_code, rows[3].revision, rows[3].detected_language, rows[3].issue_date) == ("Klej", "A1.", "3", "PL", None)
    assert (rows[4].product_name, rows[4].manufacturer_product_code, rows[4].issue_date, rows[4].detected_language) == (None, None, None, None)


def test_accepted(spark):
    profiles = spark.createDataFrame([(1, None, "YES", "x")], "sds_id long, hazardous_classification_status string, pbt_status string, note string")
    assert evidence.accepted_profiles(profiles).first().asDict() == {"sds_id": 1, "hazardous_classification_status": "NO_DATA", "pbt_status": "YES", "note": "x"}
    names = spark.createDataFrame([("a",), (" ",), (None,)], "component_name string")
    assert [r.component_name for r in evidence.accepted_components(names).collect()] == ["a"]
