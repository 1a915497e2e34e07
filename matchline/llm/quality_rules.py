"""Quality rules kept as a bitmask ledger: rules run once, policies and ablations work on their bits.

DataFrame functions only. `ledger` evaluates every rule once and stores the measurements and one bit per failed rule;
`apply_policy` keeps or rejects by a versioned mask; `ablation` counts by bitwise aggregation what each rule of a policy
rejects and what it alone rejects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

_BLANKS = r"[\x20\x09-\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """fails: a condition on the measurements; bit: its place in the mask, never used again for another rule."""

    bit: int
    name: str
    fails: str


#: Bits are permanent. Ratios are cross-multiplied, so an empty text never divides.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "10 * n_symbols > n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 20 * n_words"),
    Rule(5, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(6, "capitals", "2 * n_capitals > word_chars"),
    Rule(7, "shouting", "5 * n_marks > n_words"),
)

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {"base": ("few_words", "repeated_windows"), "v1": tuple(r.name for r in RULES)}


def mask(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id and MEASURES (long), one row per input row; null text counts as empty.

    carry: row, a struct of all of docs' columns, is kept beside them.

    Windows of three words are hashed and, only where a text holds equal ones, sorted with their places, so equal
    windows are neighbours: n log n steps per text and no shuffle.
    """
    own = documents(docs, *([F.struct("*").alias("row")] if carry else [])).withColumn("text", F.coalesce("text", F.lit("")))
    kept = ["doc_id", "row"] if carry else ["doc_id"]
    cut = own.select(
        *kept,
        F.array_remove(F.split("text", _BLANKS), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"!!")).cast("long").alias("n_marks"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_capitals"),
    )
    sized = cut.select(
        *kept,
        "n_symbols",
        "n_marks",
        "n_capitals",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(words) > 3 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END").alias("windows"),
    )
    placed = sized.withColumn(
        "placed",
        F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (h, i) -> struct(h, i))) END"),
    ).drop("windows")
    found = placed.withColumn(
        "places",
        F.expr(
            "CASE WHEN placed IS NOT NULL THEN sort_array(transform(filter(placed, (x, k) -> "
            "(k > 0 AND x.h = get(placed, k - 1).h) OR (k < size(placed) - 1 AND x.h = get(placed, k + 1).h)), x -> x.i)) END"
        ),
    ).drop("placed")
    # Windows cover three words from each place; overlapping ones count their words once.
    covered = F.expr("CASE WHEN places IS NULL THEN 0 ELSE 3 + aggregate(transform(places, (p, k) -> CASE WHEN k = 0 THEN 0 ELSE least(3, p - get(places, k - 1)) END), 0, (a, x) -> a + x) END")
    # Not deterministic, so that a filter on a rule stays above: pushed below, it would sort again for every element.
    barrier = F.when(F.spark_partition_id() < 0, 1).otherwise(0)
    return found.withColumn("n_repeat_words", (covered + barrier).cast("long")).select(*kept, *MEASURES)


def ledger(docs: DataFrame, carry: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id (row, if carried), MEASURES and failed (int): bit r.bit is set where rule r fails.

    One row per input row, repeated and null ids included; null or empty text: all measurements 0, few_words fails.
    Empty table: no rows. Other columns are ignored.
    """
    bits = [F.when(F.expr(r.fails), 1 << r.bit).otherwise(0) for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measures(docs, carry).withColumn("failed", failed.cast("int"))


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Ledger rows with base_failed, policy and kept; no text is read again."""
    fails = lambda name: F.col("failed").bitwiseAND(F.lit(mask(name))) != 0
    base = fails("base")
    return rows.select("*", base.alias("base_failed"), F.lit(policy).alias("policy"), (~base & ~fails(policy)).alias("kept"))


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: rows that fail it (n_failed) and rows that only it rejects (n_alone), by bits."""
    names = [r for r in RULES if r.name in POLICIES[policy]]
    within = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    masks = rows.groupBy(within.alias("m")).agg(F.count("*").alias("n"))  # 2 ** rules rows at most
    rules = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("b")) for r in names)))
    long = masks.select("m", "n", rules.alias("r")).select("m", "n", "r.*")
    return long.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(F.col("m").bitwiseAND(F.col("b")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("m") == F.col("b"), F.col("n"))), F.lit(0)).alias("n_alone"),
    )
