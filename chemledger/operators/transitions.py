"""State transitions as batch operators: state and requests in; new state, history rows and rejected requests with a reason out.

A batch may hold several requests for one entity. They take effect one after the other, in order of ``seq`` where requests have that column, then of
``request_id``, which is unique, so that the result is that of as many batches of one request. Nothing is changed in place. Where acceptance does not hang on earlier requests
the last or first request of an entity is found by an aggregate, which a hot entity does not slow down; only withdrawals are replayed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chemledger.plans.lookup import salted_lookup


@dataclass(frozen=True)
class Outcome:
    """The new tables by name, the history rows, and the rejected requests with their reason."""

    tables: dict[str, DataFrame]
    history: DataFrame
    rejected: DataFrame


def _split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null").select("request_id", "reason")


def turn_columns(requests: DataFrame) -> list[str]:
    return [c for c in ("seq", "request_id") if c in requests.columns]


def turn(requests: DataFrame) -> Column:
    """The place of a request in its batch."""
    return F.struct(*turn_columns(requests))


def last_of(accepted: DataFrame, *key: str) -> DataFrame:
    """Of the accepted requests the last for each ``key``, with all columns."""
    rest = [c for c in accepted.columns if c not in key]
    return accepted.groupBy(*key).agg(F.max_by(F.struct(*rest), turn(accepted)).alias("x")).select(*key, "x.*")


def _is_last(accepted: DataFrame, *key: str) -> DataFrame:
    """The accepted requests with ``last``: none for the same ``key`` comes later."""
    latest = accepted.groupBy(*key).agg(F.max(turn(accepted)).alias("latest"))
    return accepted.join(latest, list(key)).withColumn("last", turn(accepted) == F.col("latest")).drop("latest")


def _with_status(products: DataFrame, changes: DataFrame) -> DataFrame:
    """Products with the status that ``changes`` (one row each: product_id, new_status) give them."""
    return products.join(changes, "product_id", "left").withColumn("usage_status", F.coalesce("new_status", "usage_status")).drop("new_status")


def _history_id() -> Column:
    return F.sha2(F.concat_ws("/", F.col("product_id").cast("string"), F.col("request_id").cast("string")), 256)


def _history(products: DataFrame, changes: DataFrame) -> DataFrame:
    kept = [c for c in ("use_description", "use_restriction", "waste_type", "waste_code") if c in products.columns]
    return products.select("product_id", *kept).join(changes, "product_id").select(_history_id().alias("history_id"), "product_id", F.col("new_status").alias("usage_status"), *kept, F.col("at").alias("changed_at"))


def register_revisions(products: DataFrame, documents: DataFrame, requests: DataFrame) -> Outcome:
    """A new CURRENT document for a product: the one before is archived, the product waits for approval again, and a history row says so.

    ``requests``: request_id, product_id, sds_id, original_filename, relative_path, issue_date, revision, at. Of several for one product the last one's
    document is CURRENT in the end, those before are archived. Of several for one ``sds_id`` the first that is in order takes it.
    """
    known = products.select("product_id", F.lit(True).alias("known"))
    taken = documents.select("sds_id", F.lit(True).alias("taken")).distinct()
    reason = (F.when(F.col("known").isNull(), "PRODUCT_NOT_FOUND").when(F.coalesce(F.trim("relative_path"), F.lit("")) == "", "SOURCE_PATH_REQUIRED")
              .when(F.col("issue_date").isNull() | (F.coalesce(F.trim("revision"), F.lit("")) == ""), "ISSUE_DATE_AND_REVISION_REQUIRED").when(F.col("taken"), "SDS_ID_TAKEN"))
    checked = requests.join(known, "product_id", "left").join(taken, "sds_id", "left").withColumn("reason", reason).drop("known", "taken")
    takes = checked.where("reason is null").groupBy("sds_id").agg(F.min(turn(requests)).alias("first"))
    checked = checked.join(takes, "sds_id", "left").withColumn("reason", F.coalesce("reason", F.when(turn(requests) != F.col("first"), "SDS_ID_TAKEN"))).drop("first")
    accepted, rejected = _split(checked)
    touched = accepted.select("product_id", F.lit(True).alias("touched")).distinct()
    status = F.when(F.col("touched") & (F.col("document_status") == "CURRENT"), "ARCHIVED").otherwise(F.col("document_status"))
    old = documents.join(touched, "product_id", "left").withColumn("document_status", status).select(*documents.columns)
    name = F.coalesce(F.when(F.trim("original_filename") != "", F.col("original_filename")), F.regexp_extract("relative_path", r"([^/]*)$", 1))
    new = _is_last(accepted, "product_id").select(
        "sds_id", "product_id", name.alias("original_filename"), "relative_path", "issue_date", "revision", F.when(F.col("last"), "CURRENT").otherwise("ARCHIVED").alias("document_status"),
        F.col("at").alias("registered_at"), F.lit("AVAILABLE").alias("file_status"))
    changes = touched.select("product_id", F.lit("PENDING_APPROVAL").alias("new_status"))
    return Outcome({"sds_documents": old.unionByName(new.select(*documents.columns)), "products": _with_status(products, changes)}, _history(products, accepted.withColumn("new_status", F.lit("PENDING_APPROVAL"))), rejected)


def register_decisions(products: DataFrame, documents: DataFrame, profiles: DataFrame, decisions: DataFrame, evidence: DataFrame, requests: DataFrame) -> Outcome:
    """A new CURRENT decision on a product's CURRENT document; the one before is superseded and the product becomes ACTIVE or REJECTED.

    ``requests``: request_id, product_id, sds_id, decision_status, notes, evidence_relative_path, original_filename, at. The ids of the new rows are the
    request's. Of several on one document the last stays CURRENT, and the last for a product gives its status.
    """
    from chemledger.functions.text import evidence_type

    own = products.select("product_id", (F.col("use_description").isNotNull() & F.col("use_restriction").isNotNull()).alias("described"))
    sds = documents.select("sds_id", F.col("product_id").alias("owner"), "document_status")
    profiled = profiles.select("sds_id", F.lit(True).alias("profiled"))
    checked = requests.join(own, "product_id", "left").join(sds, "sds_id", "left").join(profiled, "sds_id", "left")
    reason = (F.when(F.coalesce(F.trim("original_filename"), F.lit("")) == "", "ORIGINAL_FILENAME_REQUIRED").when(F.col("described").isNull(), "PRODUCT_NOT_FOUND").when(F.col("owner").isNull(), "SDS_NOT_FOUND")
              .when(F.col("owner") != F.col("product_id"), "SDS_OF_ANOTHER_PRODUCT").when(F.col("document_status") != "CURRENT", "SDS_NOT_CURRENT").when(F.col("profiled").isNull(), "SAFETY_DATA_MISSING")
              .when(~F.col("described"), "USE_DATA_MISSING").when(evidence_type(F.col("evidence_relative_path")).isNull(), "EVIDENCE_FORMAT"))
    accepted, rejected = _split(checked.withColumn("reason", reason).drop("described", "owner", "document_status", "profiled"))
    touched = accepted.select("sds_id", F.lit(True).alias("touched")).distinct()
    record = F.when(F.col("touched") & (F.col("record_status") == "CURRENT"), "SUPERSEDED").otherwise(F.col("record_status"))
    old = decisions.join(touched, "sds_id", "left").withColumn("record_status", record).select(*decisions.columns)
    new = _is_last(accepted, "sds_id").select(
        F.col("request_id").alias("decision_id"), "product_id", "sds_id", "decision_status", "notes", F.col("at").alias("registered_at"), F.when(F.col("last"), "CURRENT").otherwise("SUPERSEDED").alias("record_status"),
        F.col("request_id").alias("evidence_id"))
    proof = accepted.select(F.col("request_id").alias("evidence_id"), "original_filename", F.col("evidence_relative_path").alias("relative_path"), evidence_type(F.col("evidence_relative_path")).alias("evidence_type"),
                            F.upper(F.regexp_extract("evidence_relative_path", r"\.([^./]+)$", 1)).alias("file_format"), F.lit("AVAILABLE").alias("file_status"))
    status = F.when(F.col("decision_status") == "APPROVED", "ACTIVE").otherwise("REJECTED")
    changes = last_of(accepted, "product_id").select("product_id", status.alias("new_status"))
    return Outcome({"bhp_decisions": old.unionByName(new.select(*decisions.columns)), "decision_evidence": evidence.unionByName(proof.select(*evidence.columns)), "products": _with_status(products, changes)},
                   _history(products, accepted.withColumn("new_status", status)), rejected)


@dataclass
class _Withdrawals:
    """What withdrawals have changed of one product so far."""

    status: str | None
    current: set
    documents: dict

    def reason(self, r: dict) -> str | None:
        """Why a withdrawal is refused in this state, or None."""
        if not (r["reason_text"] or "").strip(" "):
            return "REASON_REQUIRED"
        if not r["fits"]:
            return "MODE_DOES_NOT_FIT"
        if self.status is None:
            return "STALE_PRODUCT"
        now = self.documents.get(r["sds_id"], r["target_status"])
        if r["target_product"] is None or r["target_product"] != r["product_id"] or now != r["expected_status"]:
            return "STALE_DOCUMENT"
        if min(self.current, default=None) != r["expected_current_sds_id"]:
            return "STALE_CURRENT"
        if r["done"]:
            return "ALREADY_INVALIDATED"
        if r["mode"] == "RESTORE_ARCHIVED" and (r["restored_product"] != r["product_id"] or self.documents.get(r["restored_sds_id"], r["restored_status"]) != "ARCHIVED"):
            return "STALE_RESTORED"
        return None

    def take(self, r: dict) -> bool:
        """Carry a withdrawal out; True if the product has to wait for approval because of it."""
        self.documents[r["sds_id"]] = "INVALIDATED"
        self.current.discard(r["sds_id"])
        if r["restored_sds_id"] is not None:
            self.documents[r["restored_sds_id"]] = "CURRENT"
            self.current.add(r["restored_sds_id"])
        waits = r["expected_status"] == "CURRENT" and self.status != "PENDING_APPROVAL"
        if r["expected_status"] == "CURRENT":
            self.status = "PENDING_APPROVAL"
        return waits


def _replayed(asked: DataFrame) -> DataFrame:
    """``request_id``, ``reason`` and ``waits`` of withdrawals, each product's carried out in order. A task holds the changes of one product at a time, however many requests it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, product, begun = None, None, False
        for rows in batches:
            reasons, waits = [], []
            for r in rows.to_pylist():
                if not begun or r["product_id"] != product:
                    state, product, begun = _Withdrawals(r["old_status"], set(r["current"] or []), {}), r["product_id"], True
                why = state.reason(r)
                reasons.append(why)
                waits.append(why is None and state.take(r))
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("request_id")), pa.array(reasons, pa.string()), pa.array(waits, pa.bool_())], ["request_id", "reason", "waits"])

    return asked.repartition("product_id").sortWithinPartitions("product_id", turn(asked)).mapInArrow(run, f"request_id {dict(asked.dtypes)['request_id']}, reason string, waits boolean")


def invalidate(products: DataFrame, documents: DataFrame, decisions: DataFrame, audit: DataFrame, requests: DataFrame) -> Outcome:
    """Withdraw a document, alone or with an archived one restored in its place. The request says what it expects, and is stale if the state is another.

    ``requests``: request_id, product_id, sds_id, expected_status, expected_current_sds_id, mode (ARCHIVED_ONLY, NO_CURRENT, RESTORE_ARCHIVED), restored_sds_id, reason_text, at.
    What a request finds is what those before it have left: a document restored by one can be withdrawn by the next.
    """
    current = documents.where("document_status = 'CURRENT'").groupBy("product_id").agg(F.collect_set("sds_id").alias("current"))
    done = audit.select(F.col("invalidated_sds_id").alias("sds_id"), F.lit(True).alias("done")).distinct()
    restore = F.col("mode") == "RESTORE_ARCHIVED"
    shape = ((F.col("mode") == "ARCHIVED_ONLY") != (F.col("expected_status") == "ARCHIVED")) | (restore != F.col("restored_sds_id").isNotNull()) | F.coalesce(F.col("restored_sds_id") == F.col("sds_id"), F.lit(False))
    asked = (requests.join(products.select("product_id", F.col("usage_status").alias("old_status")), "product_id", "left").join(current, "product_id", "left")
             .join(documents.select("sds_id", F.col("product_id").alias("target_product"), F.col("document_status").alias("target_status")), "sds_id", "left").join(done, "sds_id", "left"))
    # most requests restore nothing
    asked = salted_lookup(asked.drop("at"), documents, "restored_sds_id", "sds_id", {"product_id": "restored_product", "document_status": "restored_status"}, "request_id", salts=1)
    asked = asked.withColumn("fits", F.coalesce(F.col("expected_status").isin("CURRENT", "ARCHIVED") & ~shape, F.lit(False)))
    accepted, rejected = _split(requests.join(_replayed(asked), "request_id"))
    moves = accepted.select("sds_id", F.lit("INVALIDATED").alias("to"), turn(accepted).alias("turn")).unionByName(accepted.where("restored_sds_id is not null").select(F.col("restored_sds_id").alias("sds_id"), F.lit("CURRENT").alias("to"), turn(accepted).alias("turn")))
    moves = moves.groupBy("sds_id").agg(F.max_by("to", "turn").alias("to"))
    new_documents = documents.join(moves, "sds_id", "left").withColumn("document_status", F.coalesce("to", "document_status")).select(*documents.columns)
    was_current = accepted.where("expected_status = 'CURRENT'")
    affected = was_current.select("sds_id").unionByName(was_current.where("restored_sds_id is not null").select(F.col("restored_sds_id").alias("sds_id"))).distinct().withColumn("touched", F.lit(True))
    record = F.when(F.col("touched") & (F.col("record_status") == "CURRENT"), "SUPERSEDED").otherwise(F.col("record_status"))
    new_decisions = decisions.join(affected, "sds_id", "left").withColumn("record_status", record).select(*decisions.columns)
    waits = accepted.where("waits").withColumn("new_status", F.lit("PENDING_APPROVAL"))
    rows = accepted.select(F.col("request_id").alias("invalidation_id"), "product_id", F.col("sds_id").alias("invalidated_sds_id"), F.col("expected_status").alias("invalidated_from_status"), "restored_sds_id", F.trim("reason_text").alias("reason"), F.col("at").alias("invalidated_at"))
    tables = {"sds_documents": new_documents, "bhp_decisions": new_decisions, "products": _with_status(products, waits.select("product_id", "new_status").distinct()), "sds_invalidation": audit.unionByName(rows.select(*audit.columns))}
    return Outcome(tables, _history(products, waits), rejected)


def update_administrative(products: DataFrame, requests: DataFrame) -> Outcome:
    """New use and waste data of products; the last request for one stays, each has its history row. ``requests``: request_id, product_id, use_description, use_restriction, waste_type, waste_code, at."""
    known = products.select("product_id", F.col("usage_status").alias("status"))
    accepted, rejected = _split(requests.join(known, "product_id", "left").withColumn("reason", F.when(F.col("status").isNull(), "PRODUCT_NOT_FOUND")))
    columns = ("use_description", "use_restriction", "waste_type", "waste_code")
    given = last_of(accepted, "product_id").select("product_id", *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("given"))
    rows = products.join(given, "product_id", "left").withColumns({c: F.when(F.col("given"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in columns}).select(*products.columns)
    history = accepted.select(_history_id().alias("history_id"), "product_id", F.col("status").alias("usage_status"), *columns, F.col("at").alias("changed_at"))
    return Outcome({"products": rows}, history, rejected)


def set_location_status(locations: DataFrame, requests: DataFrame) -> Outcome:
    """Activate or deactivate locations; the last request for one stays, and a history row comes also where nothing changes. ``requests``: request_id, location_id, new_status, at."""
    known = locations.select("location_id", F.lit(True).alias("known"))
    reason = F.when(F.col("known").isNull(), "LOCATION_NOT_FOUND").when(~F.coalesce(F.col("new_status").isin("ACTIVE", "INACTIVE"), F.lit(False)), "STATUS_NOT_ALLOWED")
    accepted, rejected = _split(requests.join(known, "location_id", "left").withColumn("reason", reason).drop("known"))
    given = last_of(accepted, "location_id").select("location_id", "new_status")
    rows = locations.join(given, "location_id", "left").withColumn("status", F.coalesce("new_status", "status")).select(*locations.columns)
    history = accepted.select(F.col("request_id").alias("history_id"), "location_id", F.col("new_status").alias("status"), F.col("at").alias("changed_at"))
    return Outcome({"usage_locations": rows}, history, rejected)


def create_review(reviews: DataFrame, items: DataFrame, population: DataFrame, review_id: object, review_date: Column, at: Column) -> Outcome:
    """A DRAFT review with a snapshot of the active assignments; refused while another draft is open or where there is nothing to review.

    The verdict is one row, so it may be joined to all.
    """
    draft = reviews.agg(F.coalesce(F.max(F.col("status") == "DRAFT"), F.lit(False)).alias("draft"))
    empty = population.agg((F.count(F.lit(1)) == 0).alias("empty"))
    verdict = draft.crossJoin(empty).select(F.when(F.col("draft"), "DRAFT_EXISTS").when(F.col("empty"), "EMPTY_POPULATION").alias("reason"))
    go = verdict.where("reason is null").drop("reason").withColumn("go", F.lit(True))
    new = go.select(F.lit(review_id).alias("review_id"), review_date.alias("review_date"), F.lit("DRAFT").alias("status"), at.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("finalized_at"))
    snapshot = population.crossJoin(F.broadcast(go)).select(
        F.concat_ws("/", F.lit(str(review_id)), F.col("product_id").cast("string"), F.col("location_id").cast("string")).alias("review_item_id"), F.lit(review_id).alias("review_id"), "product_id", "location_id",
        "baseline_max_quantity", "baseline_unit_id", F.lit(None).cast("decimal(18,6)").alias("observed_quantity"))
    rejected = verdict.where("reason is not null").select(F.lit(review_id).alias("request_id"), "reason")
    return Outcome({"physical_reviews": reviews.select(*new.columns).unionByName(new), "physical_review_items": items.select(*snapshot.columns).unionByName(snapshot)}, snapshot.limit(0), rejected)


def record_observed(reviews: DataFrame, items: DataFrame, requests: DataFrame) -> Outcome:
    """Observed quantities of items of an open review; the last one accepted for an item stays. ``requests``: request_id, review_item_id, observed_quantity."""
    state = items.select("review_item_id", "review_id").join(reviews.select("review_id", F.col("status").alias("review_status")), "review_id").drop("review_id")
    reason = F.when(F.col("review_status").isNull(), "ITEM_NOT_FOUND").when(F.col("review_status") != "DRAFT", "REVIEW_IS_FINAL").when(F.col("observed_quantity") < 0, "NEGATIVE_QUANTITY")
    rejected = _split(requests.join(state, "review_item_id", "left").withColumn("reason", reason))[1]
    # whether a review is open is the same for all requests on an item, so the last is found first and looked up alone
    sound = requests.where(~F.coalesce(F.col("observed_quantity") < 0, F.lit(False))).select("review_item_id", "observed_quantity", *turn_columns(requests))
    unfinished = items.join(reviews.where("status = 'DRAFT'").select("review_id"), "review_id", "left_semi").select("review_item_id").distinct()
    given = last_of(sound, "review_item_id").select("review_item_id", F.col("observed_quantity").alias("new_quantity"), F.lit(True).alias("given")).join(unfinished, "review_item_id", "left_semi")
    rows = items.join(given, "review_item_id", "left").withColumn("observed_quantity", F.when(F.col("given"), F.col("new_quantity")).otherwise(F.col("observed_quantity"))).select(*items.columns)
    return Outcome({"physical_review_items": rows}, given.limit(0), rejected)


def finalize_review(reviews: DataFrame, review_id: object, at: Column) -> DataFrame:
    """The reviews with one draft closed; final ones stay as they are."""
    hit = (F.col("review_id") == F.lit(review_id)) & (F.col("status") == "DRAFT")
    return reviews.withColumns({"status": F.when(hit, "FINAL").otherwise(F.col("status")), "finalized_at": F.when(hit, at).otherwise(F.col("finalized_at"))})


def discard_draft(reviews: DataFrame, items: DataFrame, review_id: object) -> tuple[DataFrame, DataFrame]:
    """The reviews and items without one draft; a final review is not discarded."""
    gone = reviews.where((F.col("review_id") == F.lit(review_id)) & (F.col("status") == "DRAFT")).select("review_id")
    return reviews.join(gone, "review_id", "left_anti"), items.join(gone, "review_id", "left_anti")


def delete_products(tables: dict[str, DataFrame], requests: DataFrame) -> Outcome:
    """Products and the rows that hang on them, removed. Products with an invalidation audit or review items are kept, since those rows stay. ``requests``: request_id, product_id."""
    blockers = tables["sds_invalidation"].select("product_id").unionByName(tables["physical_review_items"].select("product_id")).distinct().withColumn("blocked", F.lit(True))
    known = tables["products"].select("product_id", F.lit(True).alias("known"))
    reason = F.when(F.col("known").isNull(), "PRODUCT_NOT_FOUND").when(F.col("blocked"), "STILL_REFERENCED")
    accepted, rejected = _split(requests.join(known, "product_id", "left").join(blockers, "product_id", "left").withColumn("reason", reason).drop("known", "blocked"))
    ids = accepted.select("product_id").distinct()
    out = {name: df.join(ids, "product_id", "left_anti") for name, df in tables.items() if "product_id" in df.columns and name not in ("sds_invalidation", "physical_review_items")}
    return Outcome(out, accepted.limit(0), rejected)
