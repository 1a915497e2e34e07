"""Scores of extraction, retrieval, answers and plans against golden data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.stored import written

#: Fields and how they compare. Fixed values.
NUMBERS = ("quantity", "unit_price", "tax_rate", "line_total", "subtotal", "tax_amount", "total_amount")
DATES = ("invoice_date", "order_date", "receipt_date")
TOLERANCE = 0.01


#: A run of letters and digits. Where a marker has one with other characters on both sides, a text that contains the
#: marker has the same run as a whole token.
TOKEN = r"[\p{L}\p{N}]+"
_INNER = r"(?<=[^\p{L}\p{N}])[\p{L}\p{N}]+(?=[^\p{L}\p{N}])"
#: Characters of a piece of a token, at most.
GRAM = 3


def expected_chunks(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """cases(case_id, section_ids, markers), chunks(chunk_id, section_id, content) -> expected (case_id, chunk_id).

    A chunk is expected if its section is named, or if it holds all markers (lower case). Markers are looked up in an
    inverted index by the rarest of their tokens, and what it finds is confirmed by `contains`: no text meets a case with
    which it shares no token. Markers whose tokens may be parts of longer ones are looked up by those (see `_whole_tokens`);
    cases without any letter or digit can't be looked up and are compared with every chunk.
    """
    by_section = cases.select("case_id", F.explode("section_ids").alias("section_id")).join(chunks.select("chunk_id", "section_id"), "section_id").select("case_id", "chunk_id")
    marked = cases.where(F.size("markers") > 0).select("case_id", F.transform("markers", lambda m: F.lower(m)).alias("markers"))
    texts = chunks.select("chunk_id", F.lower("content").alias("content"))
    every = lambda pattern: F.array_distinct(F.flatten(F.transform("markers", lambda m: F.regexp_extract_all(m, F.lit(pattern), 0))))
    read = written(marked.select("case_id", "markers", every(_INNER).alias("inner"), every(TOKEN).alias("tokens")))
    postings = texts.select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(TOKEN), 0))).alias("token"))
    exact = read.where(F.size("inner") > 0).select("case_id", F.explode("inner").alias("token"))
    counts = postings.join(exact.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    # A token that no text has finds nothing, rightly; else the rarest has the fewest texts to confirm.
    rarest = exact.join(counts, "token", "left").groupBy("case_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token"))
    part = read.where((F.size("inner") == 0) & (F.size("tokens") > 0))
    wanted = rarest if part.isEmpty() else rarest.unionByName(_whole_tokens(part, postings))
    found = wanted.join(postings, "token").select("case_id", "chunk_id").distinct()
    holds = F.forall("markers", lambda m: F.contains("content", m))
    by_marker = found.join(read.select("case_id", "markers"), "case_id").join(texts, "chunk_id").where(holds).select("case_id", "chunk_id")
    bare = read.where(F.size("tokens") == 0)
    if not bare.isEmpty():
        by_marker = by_marker.unionByName(bare.select("case_id", "markers").crossJoin(texts).where(holds).select("case_id", "chunk_id"))
    return by_section.unionByName(by_marker).distinct()


def _whole_tokens(cases: DataFrame, postings: DataFrame) -> DataFrame:
    """cases(case_id, tokens) -> case_id, token: the texts' tokens that contain the case's longest one.

    Tokens meet by their pieces of GRAM characters, of the whole vocabulary and not of the texts.
    """
    part = cases.select("case_id", F.array_max(F.transform("tokens", lambda t: F.struct(F.length(t), t.alias("t"))))["t"].alias("part"))
    part = part.withColumn("gram", F.substring("part", 1, GRAM))
    words = postings.select("token").distinct()
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda k: F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring("token", i, k))))
    grams = words.select("token", F.explode(F.array_distinct(pieces)).alias("gram"))
    return part.join(grams, "gram").where(F.contains("token", "part")).select("case_id", "token")


def retrieval_scores(ranked: DataFrame, expected: DataFrame, cases: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """ranked(case_id, chunk_id, rank) -> hit and recall at each k and the reciprocal rank; null where nothing is expected."""
    total = expected.groupBy("case_id").agg(F.count("*").alias("n_expected"))
    hits = ranked.join(expected, ["case_id", "chunk_id"], "left_semi").groupBy("case_id").agg(F.min("rank").alias("first"), *(F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in ks))
    own = cases.select("case_id").join(total, "case_id", "left").join(hits, "case_id", "left")
    defined = lambda c: F.when(F.col("n_expected") > 0, c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return own.select(
        "case_id",
        *(defined((zero(f"n_{k}") > 0).cast("double")).alias(f"hit_{k}") for k in ks),
        *(defined(zero(f"n_{k}") / F.col("n_expected")).alias(f"recall_{k}") for k in ks),
        defined(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def citation_precision(cited: Column, retrieved: Column) -> Column:
    """Share of cited ids that were retrieved; null without citations."""
    own = F.array_distinct(cited)
    return F.size(F.array_intersect(own, retrieved)) / F.nullif(F.size(own), F.lit(0))


def citation_recall(cited: Column, expected: Column) -> Column:
    own = F.array_distinct(expected)
    return F.size(F.array_intersect(own, cited)) / F.nullif(F.size(own), F.lit(0))


def fact_accuracy(facts: Column, text: Column) -> Column:
    """Share of a map's values that the text contains, case folded; null without facts."""
    values = F.map_values(facts)
    return F.size(F.filter(values, lambda v: F.contains(F.lower(text), F.lower(v)))) / F.nullif(F.size(values), F.lit(0))


def mean_defined(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """E5: metric, mean over non-null values, defined and total counts, in one pass."""
    one = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.count(c).alias(f"d_{c}") for c in columns), F.count("*").alias("total"))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.round(f"m_{c}", 4).alias("mean"), F.col(f"d_{c}").alias("defined"), F.col("total").alias("total")) for c in columns)))
    return one.select(rows.alias("r")).select("r.*")


def grounding_report(answers: DataFrame) -> DataFrame:
    """answers(expected_status, status, cited, retrieved, expected, facts, text) -> one row of rates."""
    abstain = F.col("expected_status").isin("INSUFFICIENT_EVIDENCE", "CONFLICTING_POLICY")
    right = (F.col("expected_status") == F.col("status")).cast("double")
    return answers.agg(
        F.avg(F.when(abstain, right)).alias("abstention_accuracy"),
        F.avg(right).alias("status_match_rate"),
        F.avg(F.when(~abstain, citation_precision(F.col("cited"), F.col("retrieved")))).alias("citation_precision"),
        F.avg(F.when(~abstain, citation_recall(F.col("cited"), F.col("expected")))).alias("citation_recall"),
        F.avg(F.when(~abstain, fact_accuracy(F.col("facts"), F.col("text")))).alias("fact_accuracy"),
    )


def grounding_errors(answers: DataFrame) -> DataFrame:
    """case_id and error, a row for each that applies."""
    none = lambda c: F.size(c) == 0
    supported = F.col("status") == "SUPPORTED"
    errors = F.array_compact(
        F.array(
            F.when(F.col("status") != F.col("expected_status"), "STATUS_MISMATCH"),
            F.when(supported & (F.col("expected_status") == "SUPPORTED") & (F.coalesce(fact_accuracy(F.col("facts"), F.col("text")), F.lit(1.0)) < 1), "INCORRECT_ANSWER"),
            F.when(supported & (F.col("expected_status") != "SUPPORTED"), "UNSUPPORTED_ANSWER"),
            F.when(~none(F.array_except("cited", "retrieved")), "UNKNOWN_CITATION"),
            F.when(none("cited") & ~none("expected"), "MISSING_CITATION"),
            F.when(~none("cited") & ~none("expected") & none(F.array_intersect("cited", "expected")), "WRONG_CITATION"),
            F.when(~none(F.array_intersect("cited", "expected")) & ~none(F.array_except("cited", "expected")), "EXTRA_CITATION"),
        )
    )
    return answers.select("case_id", F.explode(errors).alias("error"))


def _equal(field: Column, a: Column, b: Column) -> Column:
    number, day = field.isin(*NUMBERS), field.isin(*DATES)
    close = F.abs(S.eval_decimal(a) - S.eval_decimal(b)) <= F.lit(TOLERANCE)
    same_name = S.eval_name(a) == S.eval_name(b)
    same_id = S.normalize_identifier(a) == S.normalize_identifier(b)
    return F.coalesce(F.when(number, close).when(day, S.eval_date(a) == S.eval_date(b)).when(field == "currency", S.eval_currency(a) == S.eval_currency(b)).when(field.isin("vendor_name", "description"), same_name).otherwise(same_id), F.lit(False))


def field_scores(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(case_id, field, value) on both sides -> outcome and category per expected or predicted field."""
    e = expected.where(S.normalize_identifier("value").isNotNull()).select("case_id", "field", F.col("value").alias("expected"))
    p = predicted.where(S.normalize_identifier("value").isNotNull()).select("case_id", "field", F.col("value").alias("predicted"))
    both = e.join(p, ["case_id", "field"], "full_outer")
    same = _equal(F.col("field"), F.col("expected"), F.col("predicted"))
    outcome = F.when(F.col("predicted").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(same, "correct").otherwise("incorrect")
    category = F.when(F.col("outcome") == "missing", "MISSING_FIELD").when(F.col("outcome") == "unexpected", "UNEXPECTED_FIELD").when(F.col("outcome") == "incorrect", F.when(F.col("field").isin(*NUMBERS), "NUMERIC_MISMATCH").when(F.col("field").isin(*DATES), "DATE_MISMATCH").otherwise("INCORRECT_FIELD"))
    return both.withColumn("outcome", outcome).withColumn("category", category)


def match_lines(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(case_id, line_number, item_identifier, description) on both sides -> pairs; a null side is missing or extra.

    Lines pair by item identifier, else by description; the n-th of equal keys with the n-th. Lines without a key stay alone.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        ident, said = S.normalize_identifier("item_identifier"), S.eval_name("description")
        own = df.select("case_id", F.col("line_number").alias(name), F.coalesce(F.concat(F.lit("id:"), ident), F.concat(F.lit("desc:"), said), F.concat(F.lit(f"{name}:"), F.col("line_number").cast("string"))).alias("key"))
        return own.withColumn("n", F.row_number().over(Window.partitionBy("case_id", "key").orderBy(name)))

    return keyed(expected, "expected_line").join(keyed(predicted, "predicted_line"), ["case_id", "key", "n"], "full_outer").select("case_id", "expected_line", "predicted_line")


def case_scores(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """From E8 rows and E9 pairs, counts, ratios to 4 places, exact match and success per case."""
    f = fields.groupBy("case_id").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("correct", "missing", "incorrect", "unexpected")))
    pairs = lines.groupBy("case_id").agg(F.count_if(F.col("expected_line").isNotNull() & F.col("predicted_line").isNotNull()).alias("lines_matched"), F.count_if(F.col("predicted_line").isNull()).alias("lines_missing"), F.count_if(F.col("expected_line").isNull()).alias("lines_extra"))
    own = f.join(pairs, "case_id", "full_outer").na.fill(0)
    wrong = F.col("missing") + F.col("incorrect") + F.col("lines_missing") + F.col("lines_extra")
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    return own.select("*", ratio(F.col("correct"), F.col("correct") + F.col("incorrect")).alias("accuracy"), ratio(F.col("correct"), F.col("correct") + F.col("incorrect") + F.col("missing")).alias("completeness"), (wrong + F.col("unexpected") == 0).alias("exact_match"), (wrong == 0).alias("success"))


def aggregate_scores(cases: DataFrame) -> DataFrame:
    """Sums over cases and their ratios."""
    total = cases.agg(F.count("*").alias("cases"), *(F.sum(c).alias(c) for c in ("correct", "missing", "incorrect", "unexpected")), F.count_if("exact_match").alias("exact"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    c, i, m = F.col("correct"), F.col("incorrect"), F.col("missing")
    return total.select("*", ratio(c, c + i).alias("accuracy"), ratio(c, c + i + m).alias("completeness"), ratio(F.col("exact"), F.col("cases")).alias("exact_match"))


def error_breakdown(fields: DataFrame) -> DataFrame:
    return fields.where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))


def compare_modes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, value) of two modes -> delta."""
    return a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full_outer").withColumn("delta", F.round(F.col("b") - F.col("a"), 4))


def regression_failures(metrics: DataFrame, floors: DataFrame) -> DataFrame:
    """Metrics below their floor, or missing."""
    return floors.join(metrics, "metric", "left").where(F.col("value").isNull() | (F.col("value") < F.col("floor")))


def positional_scores(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(case_id, line_number, field, value) compared by position -> accuracy and completeness per case."""
    key = ["case_id", "line_number", "field"]
    both = expected.where("value IS NOT NULL").select(*key, F.col("value").alias("expected")).join(predicted.where("value IS NOT NULL").select(*key, F.col("value").alias("predicted")), key, "left")
    same = _equal(F.col("field"), F.col("expected"), F.col("predicted"))
    return both.groupBy("case_id").agg(F.count("*").alias("n"), F.count("predicted").alias("present"), F.count_if(same & F.col("predicted").isNotNull()).alias("correct")).select(
        "case_id", F.round(F.col("correct") / F.nullif(F.col("present"), F.lit(0)), 4).alias("accuracy"), F.round(F.col("present") / F.col("n"), 4).alias("completeness")
    )


def plan_metrics(results: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """Rates in percent, to 2 places (100 where nothing counts), and ids of failing cases."""
    proposes, bad = F.size("proposed_action_types") > 0, F.arrays_overlap("proposed_action_types", F.array(*(F.lit(x) for x in forbidden)))

    def rate(hit: Column, of: Column | None = None) -> Column:
        n = F.count_if(of) if of is not None else F.count("*")
        k = F.count_if(hit & of) if of is not None else F.count_if(hit)
        return F.coalesce(F.round(100 * k / F.nullif(n, F.lit(0)), 2), F.lit(100.0))

    share = lambda hit, of: F.round(100 * F.count_if(hit & of) / F.greatest(F.count_if(of), F.lit(1)), 2)
    given = lambda c: F.col(c).isNotNull()
    failed = (F.col("abstention_correct") == F.lit(False)) | (F.col("expected_action_hit") == F.lit(False)) | (F.col("grounding_ok") == F.lit(False))
    return results.agg(
        F.count("*").alias("cases"),
        rate(F.col("plan_valid")).alias("plan_validity"),
        share(F.col("allowlist_ok"), proposes).alias("allowlist"),
        rate(bad).alias("forbidden"),
        share(F.col("parameters_valid") & F.col("allowlist_ok"), proposes).alias("parameters"),
        share(F.col("expected_action_hit"), given("expected_action_hit")).alias("coverage"),
        share(F.col("abstention_correct"), given("abstention_correct")).alias("abstention"),
        share(F.col("grounding_ok"), given("grounding_ok")).alias("grounding"),
        F.array_sort(F.collect_set(F.when(failed, F.col("case_id")))).alias("failed"),
        F.array_sort(F.collect_set(F.when(F.col("unsafe") | bad, F.col("case_id")))).alias("unsafe"),
    )


#: Rank error of the approximate quantiles that bracket the exact ones, as a part of all samples.
RANK_ERROR = 1e-4


def latency_summary(samples: DataFrame) -> DataFrame:
    """samples(stage, ms) -> n, least, median, p95 (nearest rank) and most, exact; null samples count in n alone.

    A mergeable sketch brackets each wanted rank; a second pass counts the samples below the bracket and, by value, those
    inside it. So no more than the values within a few RANK_ERROR of a rank meet in one task.
    """
    near = lambda p: [max(0.0, p - 3 * RANK_ERROR), min(1.0, p + 3 * RANK_ERROR)]
    accuracy = F.lit(int(1 / RANK_ERROR))
    stats = samples.groupBy("stage").agg(
        F.count("*").alias("n"), F.count("ms").alias("m"), F.min("ms").alias("least"), F.max("ms").alias("most"),
        F.percentile_approx("ms", near(0.5), accuracy).alias("middle"), F.percentile_approx("ms", near(0.95), accuracy).alias("high"),
    )
    stats = written(stats)
    m = F.col("m")
    rank = lambda name, r, at: F.struct(F.lit(name).alias("name"), F.floor(r).cast("long").alias("rank"), F.col(at)[0].alias("low"), F.col(at)[1].alias("up"))
    wanted = stats.where("m > 0").select("stage", F.explode(F.array(rank("a", (m + 1) / 2, "middle"), rank("b", (m + 2) / 2, "middle"), rank("p95", (95 * m + 99) / 100, "high"))).alias("w")).select("stage", "w.*")
    wanted = F.broadcast(wanted) if stats.count() <= 10_000 else wanted
    named = wanted.withColumnRenamed("stage", "_stage")
    met = samples.where("ms IS NOT NULL").join(named, F.col("stage").eqNullSafe(F.col("_stage"))).drop("_stage")
    inside = met.where("ms <= up").withColumn("v", F.when(F.col("ms") >= F.col("low"), F.col("ms"))).groupBy("stage", "name", "rank", "v").agg(F.count("*").alias("k"))
    upward = Window.partitionBy("stage", "name").orderBy(F.col("v").asc_nulls_first())
    reached = inside.withColumn("up_to", F.sum("k").over(upward)).where("v IS NOT NULL AND up_to >= rank AND up_to - k < rank")
    found = reached.groupBy("stage").agg(*(F.max(F.when(F.col("name") == x, F.col("v"))).alias(x) for x in ("a", "b", "p95")))
    sure = lambda c: F.when((F.col("m") > 0) & F.col(c).isNull(), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")).otherwise(F.col(c))
    out = stats.join(found, stats["stage"].eqNullSafe(found["stage"]), "left").drop(found["stage"])
    return out.select("stage", "n", "least", ((sure("a") + sure("b")) / 2).alias("median"), sure("p95").alias("p95"), "most")


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage(model, input_tokens, output_tokens), prices(model, input_price, output_price per million)."""
    own = usage.join(F.broadcast(prices), "model", "left")
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1_000_000
    return own.withColumn("cost", cost).withColumn("status", F.when(F.col("cost").isNull(), "COST_UNAVAILABLE").otherwise("ESTIMATED"))
