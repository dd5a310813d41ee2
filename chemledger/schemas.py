"""Explicit schemas of the registry tables, the evidence document, the manifest and the rule catalogue."""

from __future__ import annotations

from pyspark.sql import types as T

QUANTITY = T.DecimalType(18, 6)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _D, _TS, _UTC, _A = T.StringType(), T.DateType(), T.TimestampNTZType(), T.TimestampType(), T.ArrayType(T.StringType())

SAFETY_STATUS_COLUMNS = (
    "hazardous_classification_status", "pbt_status", "vpvb_status", "carcinogenicity_status",
    "germ_cell_mutagenicity_status", "reproductive_toxicity_status", "endocrine_section_2_status",
    "endocrine_section_11_status", "skin_sensitization_status", "respiratory_sensitization_status",
)

TABLES: dict[str, T.StructType] = {
    "manufacturers": _table(manufacturer_id=_S, manufacturer_name=_S),
    "products": _table(product_id=_S, product_name=_S, manufacturer_product_code=_S, manufacturer_id=_S,
                       use_description=_S, use_restriction=_S, usage_status=_S, waste_type=_S, waste_code=_S),
    "usage_locations": _table(location_id=_S, location_code=_S, location_name=_S, status=_S),
    "unit_of_measure": _table(unit_id=_S, code=_S, name=_S, category=_S, status=_S),
    "product_usage_locations": _table(
        product_id=_S, location_id=_S, peak_quantity_value=QUANTITY, peak_quantity_unit_id=_S,
        monthly_consumption_value=QUANTITY, monthly_consumption_unit_id=_S),
    "product_history": _table(history_id=_S, product_id=_S, usage_status=_S, use_description=_S,
                              use_restriction=_S, waste_type=_S, waste_code=_S, changed_at=_TS),
    "product_identity_changes": _table(
        change_id=_S, product_id=_S, change_kind=_S, old_product_name=_S, new_product_name=_S,
        old_manufacturer_product_code=_S, new_manufacturer_product_code=_S, old_manufacturer_id=_S,
        new_manufacturer_id=_S, changed_at=_UTC),
    "usage_location_history": _table(history_id=_S, location_id=_S, status=_S, changed_at=_TS),
    "product_usage_location_history": _table(
        history_id=_S, product_id=_S, location_id=_S, peak_quantity_value=QUANTITY, peak_quantity_unit_id=_S,
        monthly_consumption_value=QUANTITY, monthly_consumption_unit_id=_S, changed_at=_TS),
    "sds_documents": _table(sds_id=_S, product_id=_S, original_filename=_S, relative_path=_S, issue_date=_D,
                            revision=_S, document_status=_S, registered_at=_TS, file_status=_S),
    "decision_evidence": _table(evidence_id=_S, original_filename=_S, relative_path=_S, evidence_type=_S,
                                file_format=_S, file_status=_S),
    "bhp_decisions": _table(decision_id=_S, product_id=_S, sds_id=_S, decision_status=_S, notes=_S,
                            registered_at=_TS, record_status=_S, evidence_id=_S),
    "sds_invalidation": _table(invalidation_id=_S, product_id=_S, invalidated_sds_id=_S, invalidated_from_status=_S,
                               restored_sds_id=_S, reason=_S, invalidated_at=_UTC),
    "safety_profiles": T.StructType(
        [T.StructField("sds_id", _S), T.StructField("product_definition", _S)]
        + [T.StructField(c, _S) for c in SAFETY_STATUS_COLUMNS]
        + [T.StructField("clp_classification_text", _S), T.StructField("signal_word", _S),
           T.StructField("hazard_statements", _A), T.StructField("supplemental_hazard_statements", _A),
           T.StructField("approved_at", _TS), T.StructField("last_manual_edit_at", _TS)]),
    "sds_components": _table(component_id=_S, sds_id=_S, component_name=_S, cas_number=_S, ec_number=_S,
                             reach_registration_number=_S, concentration_text=_S, classification_text=_S,
                             hazard_statements=_A),
    "physical_reviews": _table(review_id=_S, review_date=_D, status=_S, created_at=_UTC, finalized_at=_UTC),
    "physical_review_items": _table(review_item_id=_S, review_id=_S, product_id=_S, location_id=_S,
                                    baseline_max_quantity=QUANTITY, baseline_unit_id=_S, observed_quantity=QUANTITY),
}

PROOF = _table(page=T.IntegerType(), section=_S, subsection=_S, label=_S, source_text=_S)
FIELD = _table(value=_S, domain_value=_S, state=_S, evidence=T.ArrayType(PROOF))
DOCUMENT = T.StructType([
    T.StructField("document_key", _S),
    T.StructField("page_range", T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())])),
    T.StructField("review_status", _S),
    T.StructField("product", _table(product_name=FIELD, manufacturer_product_code=FIELD)),
    T.StructField("document_metadata", _table(issue_date=FIELD, revision=FIELD)),
    T.StructField("parties", T.ArrayType(_table(role=_S, name=FIELD))),
    T.StructField("safety_profile", T.MapType(_S, FIELD)),
    T.StructField("components", T.ArrayType(_S)),
    T.StructField("validation", _table(status=_S, issues=T.ArrayType(_table(code=_S, message=_S)))),
])
EVIDENCE = T.StructType([
    T.StructField("schema", _S), T.StructField("schema_version", _S),
    T.StructField("source", _table(original_filename=_S, file_sha256=_S, page_count=T.IntegerType(), language=_S,
                                   readability_status=_S)),
    T.StructField("documents", T.ArrayType(DOCUMENT)),
    T.StructField("extraction_report", _table(logical_sds_count=T.IntegerType(), warnings=_A, errors=_A)),
])
MANIFEST = T.StructType([
    T.StructField("batch", _S), T.StructField("input_directory", _S),
    T.StructField("files", T.ArrayType(_table(id=_S, json=_S, source_file=_S, sha256=_S,
                                              logical_sds_count=T.IntegerType(), status=_S))),
])
RULE = _table(alias_id=_S, alias_text=_S, canonical_field=_S, canonical_section=_S, role=_S, location=_S, binding=_S,
              status=_S)
RULE_CATALOGUE = T.StructType([T.StructField("schema", _S), T.StructField("schema_version", _S),
                               T.StructField("aliases", T.ArrayType(RULE))])

# The allowed members of every enumerated column.
DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("products", "usage_status"): ("PENDING_APPROVAL", "ACTIVE", "REJECTED", "INACTIVE"),
    ("product_history", "usage_status"): ("PENDING_APPROVAL", "ACTIVE", "REJECTED", "INACTIVE"),
    ("usage_locations", "status"): ("ACTIVE", "INACTIVE"),
    ("usage_location_history", "status"): ("ACTIVE", "INACTIVE"),
    ("unit_of_measure", "category"): ("VOLUME", "MASS", "COUNT"),
    ("unit_of_measure", "status"): ("ACTIVE", "INACTIVE"),
    ("sds_documents", "document_status"): ("CURRENT", "ARCHIVED", "INVALIDATED"),
    ("sds_documents", "file_status"): ("AVAILABLE", "MISSING"),
    ("bhp_decisions", "decision_status"): ("APPROVED", "REJECTED"),
    ("bhp_decisions", "record_status"): ("CURRENT", "SUPERSEDED"),
    ("decision_evidence", "evidence_type"): ("EMAIL", "DOCUMENT", "PHOTO_SCAN"),
    ("decision_evidence", "file_format"): ("MSG", "PDF", "JPG", "JPEG", "PNG"),
    ("decision_evidence", "file_status"): ("AVAILABLE", "MISSING"),
    ("physical_reviews", "status"): ("DRAFT", "FINAL"),
    ("product_identity_changes", "change_kind"): ("CODE_COMPLETION", "CORRECTION"),
    ("sds_invalidation", "invalidated_from_status"): ("CURRENT", "ARCHIVED"),
    **{("safety_profiles", c): ("YES", "NO", "NO_DATA", "NOT_APPLICABLE") for c in SAFETY_STATUS_COLUMNS},
}

# Primary keys, further unique keys (with an optional row condition) and references.
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "manufacturers": ("manufacturer_id",), "products": ("product_id",), "usage_locations": ("location_id",),
    "unit_of_measure": ("unit_id",), "product_usage_locations": ("product_id", "location_id"),
    "product_history": ("history_id",), "product_identity_changes": ("change_id",),
    "usage_location_history": ("history_id",), "product_usage_location_history": ("history_id",),
    "sds_documents": ("sds_id",), "decision_evidence": ("evidence_id",), "bhp_decisions": ("decision_id",),
    "sds_invalidation": ("invalidation_id",), "safety_profiles": ("sds_id",), "sds_components": ("component_id",),
    "physical_reviews": ("review_id",), "physical_review_items": ("review_item_id",),
}
UNIQUE_KEYS: tuple[tuple[str, tuple[str, ...], str | None], ...] = (
    ("usage_locations", ("location_code",), "location_code IS NOT NULL"),
    ("unit_of_measure", ("code",), None),
    ("sds_documents", ("product_id",), "document_status = 'CURRENT'"),
    ("bhp_decisions", ("sds_id",), "record_status = 'CURRENT'"),
    ("bhp_decisions", ("evidence_id",), None),
    ("sds_documents", ("sds_id", "product_id"), None),
    ("sds_invalidation", ("invalidated_sds_id",), None),
    ("physical_reviews", ("status",), "status = 'DRAFT'"),
    ("physical_review_items", ("review_id", "product_id", "location_id"), None),
)
REFERENCES: tuple[tuple[str, tuple[str, ...], str, tuple[str, ...]], ...] = (
    ("products", ("manufacturer_id",), "manufacturers", ("manufacturer_id",)),
    ("product_usage_locations", ("product_id",), "products", ("product_id",)),
    ("product_usage_locations", ("location_id",), "usage_locations", ("location_id",)),
    ("product_usage_locations", ("peak_quantity_unit_id",), "unit_of_measure", ("unit_id",)),
    ("product_usage_locations", ("monthly_consumption_unit_id",), "unit_of_measure", ("unit_id",)),
    ("sds_documents", ("product_id",), "products", ("product_id",)),
    ("bhp_decisions", ("sds_id", "product_id"), "sds_documents", ("sds_id", "product_id")),
    ("bhp_decisions", ("evidence_id",), "decision_evidence", ("evidence_id",)),
    ("sds_invalidation", ("invalidated_sds_id",), "sds_documents", ("sds_id",)),
    ("sds_invalidation", ("restored_sds_id",), "sds_documents", ("sds_id",)),
    ("safety_profiles", ("sds_id",), "sds_documents", ("sds_id",)),
    ("sds_components", ("sds_id",), "sds_documents", ("sds_id",)),
    ("physical_review_items", ("review_id",), "physical_reviews", ("review_id",)),
    ("physical_review_items", ("product_id",), "products", ("product_id",)),
    ("physical_review_items", ("location_id",), "usage_locations", ("location_id",)),
    ("physical_review_items", ("baseline_unit_id",), "unit_of_measure", ("unit_id",)),
    ("product_history", ("product_id",), "products", ("product_id",)),
    ("product_identity_changes", ("product_id",), "products", ("product_id",)),
    ("usage_location_history", ("location_id",), "usage_locations", ("location_id",)),
    ("product_usage_location_history", ("product_id",), "products", ("product_id",)),
    ("product_usage_location_history", ("location_id",), "usage_locations", ("location_id",)),
    ("product_usage_location_history", ("peak_quantity_unit_id",), "unit_of_measure", ("unit_id",)),
    ("product_usage_location_history", ("monthly_consumption_unit_id",), "unit_of_measure", ("unit_id",)),
)
CHECKS: tuple[tuple[str, str, str], ...] = (
    ("usage_locations", "location_code_format", "location_code IS NULL OR location_code RLIKE '^[A-Z0-9][A-Z0-9_-]{0,31}$'"),
    ("product_usage_locations", "peak_quantity_nonnegative", "peak_quantity_value >= 0"),
    ("product_usage_locations", "monthly_consumption_nonnegative",
     "monthly_consumption_value IS NULL OR monthly_consumption_value >= 0"),
    ("product_usage_locations", "monthly_consumption_pair",
     "(monthly_consumption_value IS NULL) = (monthly_consumption_unit_id IS NULL)"),
    ("product_usage_location_history", "monthly_consumption_pair",
     "(monthly_consumption_value IS NULL) = (monthly_consumption_unit_id IS NULL)"),
    ("sds_invalidation", "reason_not_blank", "length(trim(reason)) > 0"),
    ("sds_invalidation", "distinct_restored", "restored_sds_id IS NULL OR restored_sds_id <> invalidated_sds_id"),
    ("physical_reviews", "finalized_at_matches_status", "(status = 'FINAL') = (finalized_at IS NOT NULL)"),
    ("physical_review_items", "baseline_nonnegative", "baseline_max_quantity >= 0"),
    ("physical_review_items", "observed_nonnegative", "observed_quantity IS NULL OR observed_quantity >= 0"),
)
