"""Risk scores from signals: capped, weighted by severity and age, for vendors, invoices and orders at once."""

from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.folds import folded

#: Weight and cap of each signal type.
WEIGHTS = {"PRICE_VARIANCE": (15, 30), "QUANTITY_VARIANCE": (15, 30), "DUPLICATE_INVOICE": (25, 40), "TIMING_ANOMALY": (10, 20), "VENDOR_SPIKE": (20, 30), "REPEATED_MISMATCH": (20, 30)}
VERSION = "v1"


def _of_type(c: str, which: int) -> Column:
    out = F.when(F.lit(False), F.lit(Decimal(0)))
    for kind, values in WEIGHTS.items():
        out = out.when(F.col(c) == kind, F.lit(Decimal(values[which])))
    return out


def signals_as_of(signals: DataFrame, as_of: datetime.date) -> DataFrame:
    """K1: signals up to the end of the day."""
    return signals.where(F.col("detected_at") < F.lit(as_of + datetime.timedelta(days=1)).cast("timestamp"))


def entity_signals(signals: DataFrame) -> DataFrame:
    """K2: a row for each of a signal's vendor, invoice and order."""
    entity = F.array(*(F.struct(F.lit(kind).alias("entity_type"), F.col(c).alias("entity_id")) for kind, c in (("VENDOR", "vendor_id"), ("INVOICE", "invoice_id"), ("PURCHASE_ORDER", "po_id"))))
    keep = [c for c in signals.columns if c not in ("vendor_id", "invoice_id", "po_id")]
    return signals.select(*keep, F.explode(entity).alias("e")).where("e.entity_id IS NOT NULL").select("e.entity_type", "e.entity_id", *keep)


def contributions(signals: DataFrame, as_of: datetime.date) -> DataFrame:
    """K3: weight x severity x recency, half up to 4 places."""
    days = S.days_since("detected_at", F.lit(as_of))
    return signals.withColumn("contribution", F.round(_of_type("anomaly_type", 0) * S.severity_score("severity") * S.recency_multiplier(days), 4).cast("decimal(18,4)"))


def type_breakdown(rows: DataFrame) -> DataFrame:
    """K4: per entity and type the sum, the capped sum and the count."""
    sums = rows.groupBy("entity_type", "entity_id", "anomaly_type").agg(F.sum("contribution").cast("decimal(18,4)").alias("raw"), F.count("*").alias("signal_count"))
    return sums.withColumn("capped", F.least("raw", _of_type("anomaly_type", 1).cast("decimal(18,4)")))


def score_profiles(signals: DataFrame, entities: DataFrame, as_of: datetime.date, version: str = VERSION) -> DataFrame:
    """K5: entities(entity_type, entity_id) -> score, band, counts and fingerprint; without signals 0 and LOW.

    Two levels of aggregation with map-side combining. A profile's identity hashes all fingerprints of its entity in
    order; they stream through the hash, so an entity of any number of signals holds one state.
    """
    key = ["entity_type", "entity_id"]
    rows = contributions(entity_signals(signals_as_of(signals, as_of)), as_of)
    per_type = type_breakdown(rows)
    scores = per_type.groupBy(*key).agg(F.sum("capped").alias("aggregate"), F.sum("signal_count").alias("signal_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("anomaly_type", "capped")))).alias("breakdown"))
    levels = rows.groupBy(*key).agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in S.SEVERITY_SCORES))
    head = F.concat_ws("|", "entity_type", F.col("entity_id").cast("string"), F.lit(version), F.lit(as_of.isoformat()))
    prints = folded(rows.select(*key, "fingerprint", head.alias("head")), key, "fingerprint", "sha256", "head")
    own = entities.join(scores, key, "left").join(levels, key, "left").join(prints, key, "left")
    score = S.normalize_score(F.coalesce("aggregate", F.lit(Decimal(0))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return own.select(
        "entity_type", "entity_id", score.alias("score"), S.band_for_score(score).alias("risk_band"), F.lit(version).alias("score_version"), F.lit(as_of).alias("as_of"), zero("signal_count"), "breakdown",
        *(zero(f"n_{s.lower()}") for s in S.SEVERITY_SCORES), F.coalesce("folded", F.sha2(head, 256)).alias("fingerprint"),
    )


def latest_profiles(profiles: DataFrame) -> DataFrame:
    """K6: rows of the newest day per entity and version; ties stay."""
    newest = profiles.groupBy("entity_type", "entity_id", "score_version").agg(F.max("as_of").alias("as_of"))
    return profiles.join(newest, ["entity_type", "entity_id", "score_version", "as_of"], "left_semi").select(profiles.columns)


def profile_history(profiles: DataFrame, as_of: datetime.date | None = None) -> DataFrame:
    """K7: place (1 is newest) in each entity's history; current marks the newest row, or that of as_of."""
    order = Window.partitionBy("entity_type", "entity_id").orderBy(F.desc("as_of"), F.desc("calculated_at"), F.desc("profile_id"))
    own = profiles.withColumn("place", F.row_number().over(order))
    return own.withColumn("current", F.col("place") == 1 if as_of is None else F.col("as_of") == F.lit(as_of))


def list_latest_profiles(profiles: DataFrame, vendors: DataFrame, inv: DataFrame, po: DataFrame, band: str | None = None, entity_type: str | None = None) -> DataFrame:
    """K8: K6 with a label from the entity's table and the total of listed rows."""
    own = latest_profiles(profiles)
    if band:
        own = own.where(F.col("risk_band") == band)
    if entity_type:
        own = own.where(F.col("entity_type") == entity_type)
    labels = (
        vendors.select(F.lit("VENDOR").alias("entity_type"), F.col("vendor_id").alias("entity_id"), F.col("name").alias("label"))
        .unionByName(inv.select(F.lit("INVOICE").alias("entity_type"), F.col("invoice_id").alias("entity_id"), F.col("invoice_number").alias("label")))
        .unionByName(po.select(F.lit("PURCHASE_ORDER").alias("entity_type"), F.col("po_id").alias("entity_id"), F.col("po_number").alias("label")))
    )
    total = own.agg(F.count("*").alias("total"))
    return own.join(labels, ["entity_type", "entity_id"], "left").withColumn("label", F.coalesce("label", F.col("entity_id").cast("string"))).crossJoin(F.broadcast(total))
