"""More transitions: identities completed and corrected, manufacturers and products resolved or created, locations and quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chemledger.functions.text import location_code
from chemledger.operators.transitions import Outcome, _split, last_of, register_revisions, turn, turn_columns
from chemledger.plans import spread


def new_id(*parts: str) -> Column:
    """An id that the given columns decide."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(p).cast("string"), F.lit("\u0000")) for p in parts]), 256)


def _changes(accepted: DataFrame, kind: str) -> DataFrame:
    """Audit rows: what a product was called before and after. ``accepted``: request_id, product_id, at, and structs ``old`` and ``new`` of product_name, manufacturer_product_code, manufacturer_id."""
    sides = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in ("product_name", "manufacturer_product_code", "manufacturer_id") for side in ("old", "new")]
    return accepted.select(F.col("request_id").alias("change_id"), "product_id", F.lit(kind).alias("change_kind"), *sides, F.col("at").alias("changed_at"))


def _first_of(checked: DataFrame, requests: DataFrame, key: str, late: str) -> DataFrame:
    """Requests of which only the first in order for each ``key`` is accepted; later ones get the reason ``late``."""
    first = checked.where("reason is null").groupBy(key).agg(F.min(turn(requests)).alias("first"))
    return checked.join(first, key, "left").withColumn("reason", F.coalesce("reason", F.when(turn(requests) != F.col("first"), late))).drop("first")


def complete_codes(products: DataFrame, requests: DataFrame) -> Outcome:
    """Give products without a code theirs; the first request in order for a product does, for later ones the code is known. ``requests``: request_id, product_id, code, at."""
    known = products.select("product_id", F.struct("product_name", "manufacturer_product_code", "manufacturer_id").alias("old"))
    reason = F.when(F.coalesce(F.trim("code"), F.lit("")) == "", "CODE_REQUIRED").when(F.col("old").isNull(), "PRODUCT_NOT_FOUND").when(F.col("old.manufacturer_product_code").isNotNull(), "CODE_KNOWN")
    accepted, rejected = _split(_first_of(requests.join(known, "product_id", "left").withColumn("reason", reason), requests, "product_id", "CODE_KNOWN"))
    given = accepted.select("product_id", F.trim("code").alias("given"))
    rows = products.join(given, "product_id", "left").withColumn("manufacturer_product_code", F.coalesce("given", "manufacturer_product_code")).select(*products.columns)
    audit = accepted.withColumn("new", F.col("old").withField("manufacturer_product_code", F.trim("code")))
    return Outcome({"products": rows}, _changes(audit, "CODE_COMPLETION"), rejected)


def _makers(manufacturers: DataFrame) -> DataFrame:
    return manufacturers.groupBy(F.col("manufacturer_name").alias("wanted_maker")).agg(F.count(F.lit(1)).alias("makers"), F.min("manufacturer_id").alias("maker_id"))


def correct_identities(products: DataFrame, manufacturers: DataFrame, requests: DataFrame) -> Outcome:
    """New name, code and manufacturer of products; an unknown manufacturer is created once. ``requests``: request_id, product_id, product_name, code, manufacturer_name, at.

    Several requests for a product follow each other: each is compared with what the one before left. A product that has lost its code stays without one, as
    giving it a code is a transition of its own; so a request passes if it has no code, or if the product has one and no request before it took that away.
    A request that changes nothing leaves what it asks for too, so the state before a request is what the last passing one asks for.
    """
    own = products.select("product_id", F.struct("product_name", "manufacturer_product_code", "manufacturer_id").alias("kept"))
    # dealt once, into a given number of partitions: rows that shrink well would be joined to few, whose sorts take much memory. A few makers are named by most requests
    dealt = requests.withColumnRenamed("manufacturer_name", "wanted_maker").repartition(spread.sorted_partitions(requests.sparkSession), "product_id")
    asked = dealt.join(own, "product_id", "left").join(F.broadcast(_makers(manufacturers)), "wanted_maker", "left")
    asked = asked.withColumn("new", F.struct("product_name", F.col("code").alias("manufacturer_product_code"), F.coalesce(F.col("maker_id").cast("string"), new_id("wanted_maker")).alias("manufacturer_id")))
    asked = asked.withColumn("kept", F.col("kept").withField("manufacturer_id", F.col("kept.manufacturer_id").cast("string")))
    before = Window.partitionBy("product_id").orderBy(turn(requests)).rowsBetween(Window.unboundedPreceding, -1)
    fit = F.col("kept").isNotNull() & (F.coalesce("makers", F.lit(0)) < 2)
    asked = asked.withColumn("codeless", F.col("kept.manufacturer_product_code").isNull() | F.coalesce(F.max(fit & F.col("code").isNull()).over(before), F.lit(False)))
    separate = F.col("codeless") & F.col("code").isNotNull()
    asked = asked.withColumn("old", F.coalesce(F.last(F.when(fit & ~separate, F.col("new")), ignorenulls=True).over(before), "kept"))
    reason = (F.when(F.col("kept").isNull(), "PRODUCT_NOT_FOUND").when(separate, "CODE_COMPLETION_IS_SEPARATE")
              .when(F.col("makers") > 1, "MANUFACTURER_AMBIGUOUS").when(F.col("new").eqNullSafe(F.col("old")), "NO_CHANGE"))
    accepted, rejected = _split(asked.withColumn("reason", reason))
    given = last_of(accepted.select("product_id", "new", *turn_columns(requests)), "product_id").select("product_id", "new", F.lit(True).alias("given"))
    pick = lambda c: F.when(F.col("given"), F.col(f"new.{c}")).otherwise(F.col(c).cast("string"))
    rows = products.join(given, "product_id", "left").withColumns({c: pick(c) for c in ("product_name", "manufacturer_product_code", "manufacturer_id")}).select(*products.columns)
    created = accepted.where("makers is null").select(F.col("new.manufacturer_id").alias("manufacturer_id"), F.col("wanted_maker").alias("manufacturer_name")).distinct()
    makers = manufacturers.select(F.col("manufacturer_id").cast("string").alias("manufacturer_id"), "manufacturer_name").unionByName(created)
    return Outcome({"products": rows, "manufacturers": makers}, _changes(accepted, "CORRECTION"), rejected)


def correct_and_register(products: DataFrame, manufacturers: DataFrame, documents: DataFrame, requests: DataFrame) -> Outcome:
    """A correction of a product's identity and the revision that shows it, together or not at all: no product is corrected whose revision is refused, and the other way round.

    ``requests``: the columns of ``correct_identities`` and of ``register_revisions``; both take effect in order. A sound revision holds its ``sds_id`` against
    later requests even if its correction is refused. The history rows are those of the revisions; the audit of the corrections is among the tables.
    """
    rejected = register_revisions(products, documents, requests).rejected
    sound = requests.join(rejected.select("request_id"), "request_id", "left_anti")
    corrected = correct_identities(products, manufacturers, sound)
    both = sound.join(corrected.rejected.select("request_id"), "request_id", "left_anti")
    revised = register_revisions(corrected.tables["products"], documents, both)
    tables = {**corrected.tables, **revised.tables, "product_identity_changes": corrected.history}
    return Outcome(tables, revised.history, rejected.unionByName(corrected.rejected))


def resolve_or_create(products: DataFrame, manufacturers: DataFrame, requests: DataFrame) -> DataFrame:
    """The manufacturer and product each request means: ``manufacturer_id`` and ``product_id`` with LINKED or CREATED, or a rejection where the manufacturer's name is not unique.

    ``requests``: request_id, manufacturer_name, product_name, code. Ids of what is created follow from the names, so equal requests share them. A null code links nothing.
    """
    rows = requests.withColumnRenamed("manufacturer_name", "wanted_maker").join(_makers(manufacturers), "wanted_maker", "left")
    rows = rows.withColumn("manufacturer_id", F.when(F.coalesce("makers", F.lit(0)) < 2, F.coalesce(F.col("maker_id").cast("string"), new_id("wanted_maker"))))
    own = products.groupBy("product_name", F.col("manufacturer_product_code").alias("code"), F.col("manufacturer_id").cast("string").alias("manufacturer_id")).agg(F.min("product_id").cast("string").alias("found"))
    rows = rows.join(own, ["product_name", "code", "manufacturer_id"], "left")
    return rows.select(
        "request_id", "manufacturer_id", F.when(F.col("makers") > 1, "AMBIGUOUS").when(F.col("makers") == 1, "LINKED").otherwise("CREATED").alias("manufacturer_action"),
        F.when(F.col("manufacturer_id").isNotNull(), F.coalesce("found", new_id("product_name", "code", "manufacturer_id"))).alias("product_id"),
        F.when(F.col("manufacturer_id").isNull(), "REJECTED").when(F.col("found").isNotNull(), "LINKED").otherwise("CREATED").alias("product_action"))


def create_locations(locations: DataFrame, requests: DataFrame) -> Outcome:
    """New ACTIVE locations. The first request for a code takes it. ``requests``: request_id, location_id, location_name, location_code."""
    asked = requests.withColumn("code", location_code(F.col("location_code")))
    taken = locations.where("location_code is not null").select(F.col("location_code").alias("code"), F.lit(True).alias("taken")).distinct()
    first = asked.where("code is not null").groupBy("code").agg(F.min("request_id").alias("first"))
    reason = F.when(F.col("code").isNull(), "CODE_FORMAT").when(F.col("taken") | (F.col("first") != F.col("request_id")), "CODE_TAKEN")
    accepted, rejected = _split(asked.join(taken, "code", "left").join(first, "code", "left").withColumn("reason", reason))
    new = accepted.select("location_id", F.col("code").alias("location_code"), "location_name", F.lit("ACTIVE").alias("status"))
    return Outcome({"usage_locations": locations.unionByName(new.select(*locations.columns))}, new.limit(0), rejected)


def assign_legacy_codes(locations: DataFrame, requests: DataFrame) -> Outcome:
    """Codes for locations that have none yet. ``requests``: request_id, location_id, location_code."""
    asked = requests.withColumn("code", location_code(F.col("location_code"))).drop("location_code")
    own = locations.select("location_id", F.struct("location_code").alias("old"))
    taken = locations.where("location_code is not null").select(F.col("location_code").alias("code"), F.lit(True).alias("taken")).distinct()
    first = asked.where("code is not null").groupBy("code").agg(F.min("request_id").alias("first"))
    reason = (F.when(F.col("old").isNull(), "LOCATION_NOT_FOUND").when(F.col("old.location_code").isNotNull(), "CODE_ASSIGNED").when(F.col("code").isNull(), "CODE_FORMAT")
              .when(F.col("taken") | (F.col("first") != F.col("request_id")), "CODE_TAKEN"))
    accepted, rejected = _split(asked.join(own, "location_id", "left").join(taken, "code", "left").join(first, "code", "left").withColumn("reason", reason))
    rows = locations.join(accepted.select("location_id", "code"), "location_id", "left").withColumn("location_code", F.coalesce("code", "location_code")).select(*locations.columns)
    return Outcome({"usage_locations": rows}, accepted.limit(0), rejected)


QUANTITIES = ("peak_quantity_value", "peak_quantity_unit_id", "monthly_consumption_value", "monthly_consumption_unit_id")


def set_quantities(assignments: DataFrame, locations: DataFrame, units: DataFrame, requests: DataFrame, new: bool) -> Outcome:
    """Quantities of a product at a location: assigned (``new``, to ACTIVE locations) or updated. Units must be ACTIVE, quantities not negative, monthly value and unit both given or both not.

    ``requests``: request_id, product_id, location_id, the four quantity columns, at. The first request in order assigns a place, for later ones it is
    assigned; of several updates the last stays.
    """
    place = locations.select("location_id", F.col("status").alias("place"))
    usable = units.where("status = 'ACTIVE'").select("unit_id")
    # units are few and named by all requests, most of which have no monthly one: dealt by unit, all would meet in one task
    unit = lambda c, out: F.broadcast(usable.select(F.col("unit_id").alias(c), F.lit(True).alias(out)))
    there = assignments.select("product_id", "location_id", F.lit(True).alias("there"))
    checked = requests.join(unit("peak_quantity_unit_id", "peak_ok"), "peak_quantity_unit_id", "left").join(unit("monthly_consumption_unit_id", "monthly_ok"), "monthly_consumption_unit_id", "left").join(place, "location_id", "left").join(there, ["product_id", "location_id"], "left")
    pair = F.col("monthly_consumption_value").isNull() != F.col("monthly_consumption_unit_id").isNull()
    negative = F.coalesce(F.col("peak_quantity_value") < 0, F.lit(True)) | F.coalesce(F.col("monthly_consumption_value") < 0, F.lit(False))
    reason = (F.when(F.lit(new) & F.col("place").isNull(), "LOCATION_NOT_FOUND").when(F.lit(new) & (F.col("place") != "ACTIVE"), "LOCATION_INACTIVE").when(negative, "QUANTITY_NOT_ALLOWED").when(pair, "MONTHLY_PAIR")
              .when(F.col("peak_ok").isNull() | (F.col("monthly_consumption_unit_id").isNotNull() & F.col("monthly_ok").isNull()), "UNIT_INACTIVE")
              .when(F.lit(new) & F.col("there"), "ALREADY_ASSIGNED").when(F.lit(not new) & F.col("there").isNull(), "ASSIGNMENT_NOT_FOUND"))
    checked = checked.withColumn("reason", reason)
    if new:
        place = F.struct("product_id", "location_id")
        checked = _first_of(checked.withColumn("place_key", place), requests, "place_key", "ALREADY_ASSIGNED").drop("place_key")
    accepted, rejected = _split(checked)
    if new:
        rows = assignments.unionByName(accepted.select(*assignments.columns))
    else:
        given = last_of(accepted, "product_id", "location_id").select("product_id", "location_id", *[F.col(c).alias(f"given_{c}") for c in QUANTITIES], F.lit(True).alias("given"))
        rows = assignments.join(given, ["product_id", "location_id"], "left").withColumns({c: F.when(F.col("given"), F.col(f"given_{c}")).otherwise(F.col(c)) for c in QUANTITIES}).select(*assignments.columns)
    history = accepted.select(F.col("request_id").alias("history_id"), "product_id", "location_id", *QUANTITIES, F.col("at").alias("changed_at"))
    return Outcome({"product_usage_locations": rows}, history, rejected)
