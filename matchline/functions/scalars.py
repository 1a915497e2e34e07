"""Scalar functions on columns: normalisers, severity ladders, fingerprints, periods. All stay in the JVM."""

from __future__ import annotations

import base64
import datetime
import functools
import sys
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str

#: Fixed values.
MISSING_WORDS = ("not provided", "not available", "n/a", "na", "none", "null", "unknown", "not specified", "not applicable", "-", "--")
SENSITIVE = ("api_key", "apikey", "password", "secret", "token", "authorization", "credential", "private_key")
SEVERITY_SCORES = {"LOW": "0.25", "MEDIUM": "0.50", "HIGH": "0.75", "CRITICAL": "1.00"}
PERCENT_STEPS = (("CRITICAL", 50), ("HIGH", 25), ("MEDIUM", 10), ("LOW", 5))
RATIO_STEPS = (("CRITICAL", "5"), ("HIGH", "3"), ("MEDIUM", "2"))
RATE_STEPS = (("CRITICAL", "0.75"), ("HIGH", "0.50"), ("MEDIUM", "0.30"))
RECENCY = ((30, "1.00"), (90, "0.75"), (180, "0.50"))
RECENCY_OLD = "0.25"
BANDS = ((75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM"))
MAX_AGGREGATE = 180


def _c(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fenced(c: Col) -> Column:
    """The column, marked as not deterministic: filters on what is derived from it stay above its projection.

    Below it, a filter would repeat the whole derivation for every place where it names the column.
    """
    return F.when(F.spark_partition_id() >= 0, _c(c))


@functools.cache
def _case_folds() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one other, what they fold to, and those that fold to several, by Python's own table."""
    folds = {c: f for c in map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))) if (f := c.casefold()) != c}
    single = [c for c, f in folds.items() if len(f) == 1]
    return "".join(single), "".join(folds[c] for c in single), {c: f for c, f in folds.items() if len(f) > 1}


def casefold(c: Col) -> Column:
    """U4: full case folding: like lower case, but `ß` is `ss` and final sigma is sigma. Built-in functions only."""
    single, to, several = _case_folds()
    own = F.translate(_c(c), single, to)
    pieces = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    spread = F.array_join(F.transform(F.split(own, ""), lambda x: F.coalesce(F.try_element_at(pieces, x), x)), "")
    folded = F.when(own.rlike(f"[{''.join(several)}]"), spread).otherwise(own)
    return F.when(_c(c).rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(_c(c)))  # ASCII is the common case


def normalize_invoice_number(c: Col) -> Column:
    """Trimmed, case folded, runs of blanks and underscores as one dash, no dashes at the ends."""
    joined = F.regexp_replace(casefold(F.trim(_c(c))), r"[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(joined, "-{2,}", "-"), "^-+|-+$", "")


def fingerprint(*parts: Col | int | None) -> Column:
    """SHA-256 of the parts joined by '|'. Strings name literals here; columns are given as Column; null is empty."""
    text = [F.lit("" if p is None else str(p)) if not isinstance(p, Column) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *text), 256)


def percent_variance(expected: Col, actual: Col) -> Column:
    """Difference in percent of expected (double); against 0 it is 0 or 100."""
    e, a = _c(expected).cast("double"), _c(actual).cast("double")
    return F.when(e == 0, F.when(a == 0, 0.0).otherwise(100.0)).otherwise(F.abs(a - e) / F.nullif(F.abs(e), F.lit(0.0)) * 100)


def reaches_percent(expected: Col, actual: Col, percent: int | str | Decimal, strict: bool = False) -> Column:
    """Whether the variance is at least (strict: above) percent, exactly: decimals are cross-multiplied."""
    e, a = _c(expected), _c(actual)
    diff, bound = F.abs(a - e) * F.lit(Decimal(100)), F.abs(e) * F.lit(Decimal(str(percent)))
    off_zero = F.lit(Decimal(str(percent)) < 100 if strict else Decimal(str(percent)) <= 100)
    from_zero = F.when(a == 0, F.lit(False if strict else Decimal(str(percent)) <= 0)).otherwise(off_zero)
    return F.when(e == 0, from_zero).otherwise(diff > bound if strict else diff >= bound)


def exceeds_percent(expected: Col, actual: Col, tolerance: int | str | Decimal = 0) -> Column:
    return reaches_percent(expected, actual, tolerance, strict=True)


def exceeds_quantity(left: Col, right: Col, tolerance: int | str | Decimal = 0) -> Column:
    return _c(left) - _c(right) > F.lit(Decimal(str(tolerance)))


def _ladder(steps, test) -> Column:
    out = None
    for name, least in steps:
        out = F.when(test(least), name) if out is None else out.when(test(least), name)
    return out


def severity_percent(expected: Col, actual: Col, steps=PERCENT_STEPS) -> Column:
    return _ladder(steps, lambda least: reaches_percent(expected, actual, least))


def severity_ratio(ratio: Col, steps=RATIO_STEPS) -> Column:
    return _ladder(steps, lambda least: _c(ratio) >= F.lit(Decimal(least)))


def severity_rate(rate: Col, steps=RATE_STEPS) -> Column:
    return _ladder(steps, lambda least: _c(rate) >= F.lit(Decimal(least)))


def severity_score(c: Col) -> Column:
    out = F.when(F.lit(False), F.lit(Decimal("0.00")))
    for name, score in SEVERITY_SCORES.items():
        out = out.when(_c(c) == name, F.lit(Decimal(score)))
    return out


def normalize_identifier(c: Col) -> Column:
    return F.nullif(F.trim(F.regexp_replace(_c(c), r"\s+", " ")), F.lit(""))


def is_missing_value(c: Col) -> Column:
    own = F.lower(F.trim(F.regexp_replace(_c(c), r"\s+", " ")))  # named once: inside lambdas every mention is worked out anew
    return F.coalesce(own.isin("", *MISSING_WORDS), F.lit(True))


def normalize_business_value(c: Col) -> Column:
    own = F.trim(F.regexp_replace(_c(c), r"\s+", " "))
    return F.when(~F.lower(own).isin("", *MISSING_WORDS), own)


NUMBER = "decimal(38,10)"


def _number(c: Column) -> Column:
    return F.regexp_extract(c, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", 0).try_cast(NUMBER)  # no match is an empty text, which is no number


def normalize_money(c: Col) -> Column:
    """Without blanks, thousands commas and currency signs; parentheses mean minus; null where it isn't a number."""
    return _number(F.replace(F.replace(F.regexp_replace(_c(c), "[,\\s₹$€£]", ""), F.lit("("), F.lit("-")), F.lit(")"), F.lit("")))


def normalize_quantity(c: Col) -> Column:
    return _number(F.replace(F.trim(_c(c)), F.lit(","), F.lit("")))


def normalize_percentage(c: Col) -> Column:
    """A fraction: 18 % and 18 are 0.18, 0.18 stays; negative is null."""
    n = _number(F.replace(F.trim(F.regexp_replace(F.trim(_c(c)), r"\s*%\s*$", "")), F.lit(","), F.lit("")))
    return F.when(n < 0, None).when(n > 1, (n / 100).cast(NUMBER)).otherwise(n)


_DATES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
)


def normalize_date(c: Col) -> Column:
    """The first of seven formats that parses, day first before month first; two-digit years from 69 on are 19yy."""
    own, tried = F.trim(_c(c)), []
    for shape, pattern in _DATES:
        day = F.when(own.rlike(shape), F.try_to_date(own, pattern))
        tried.append(F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day) if pattern.endswith("yy") else day)
    return F.coalesce(*tried)


def contains_escaped(c: Col, query: str) -> Column:
    """Case-insensitive contains; wildcards in the query stand for themselves."""
    return F.contains(F.lower(_c(c)), F.lit(query.lower()))


def drop_sensitive_keys(c: Col) -> Column:
    """A flat map without entries whose key names a credential."""
    return F.map_filter(_c(c), lambda k, v: ~F.lower(k).rlike("|".join(SENSITIVE)))


def content_sha256(c: Col) -> Column:
    return F.sha2(_c(c), 256)


def parameters_hash(c: Col) -> Column:
    """SHA-256 of a string map as JSON with sorted keys and no spaces."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_c(c))))), 256)


def period_bucket(c: Col, period: str) -> Column:
    """Label of the day, the ISO week or the month."""
    t = _c(c)
    if period == "daily":
        return F.date_format(t, "yyyy-MM-dd")
    if period == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    if period == "monthly":
        return F.date_format(t, "yyyy-MM")
    raise ValueError(f"unknown period {period!r}")


def days_since(detected_at: Col, as_of: Col) -> Column:
    return F.greatest(F.datediff(_c(as_of), F.to_date(_c(detected_at))), F.lit(0))


def recency_multiplier(days: Col) -> Column:
    d = _c(days)
    out = None
    for last, m in RECENCY:
        out = F.when(d <= last, F.lit(Decimal(m))) if out is None else out.when(d <= last, F.lit(Decimal(m)))
    return out.otherwise(F.lit(Decimal(RECENCY_OLD)))


def normalize_score(aggregate: Col) -> Column:
    """0 to 100, half up."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(_c(aggregate) * 100 / MAX_AGGREGATE).cast("int")))


def band_for_score(score: Col) -> Column:
    out = None
    for least, band in BANDS:
        out = F.when(_c(score) >= least, band) if out is None else out.when(_c(score) >= least, band)
    return out.otherwise("LOW")


def eval_name(c: Col) -> Column:
    return F.lower(normalize_identifier(c))


def eval_currency(c: Col) -> Column:
    return F.nullif(F.upper(F.regexp_replace(_c(c), r"[^\p{L}]", "")), F.lit(""))


def eval_decimal(c: Col) -> Column:
    return _number(F.regexp_replace(_c(c), "[,\\s₹$€£]", ""))


def eval_date(c: Col) -> Column:
    """ISO dates; day-first ones only where the day can't be a month."""
    own = F.trim(_c(c))
    iso = F.when(own.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(own, "yyyy-MM-dd"))
    day = F.regexp_extract(own, r"^(\d{1,2})[/.-]\d{1,2}[/.-]\d{4}$", 1)
    other = F.when(day.try_cast("int") > 12, F.try_to_date(F.regexp_replace(own, r"[/.]", "-"), "d-M-y"))
    return F.coalesce(iso, other)


def l2_normalize(c: Col) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(_c(c), F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(_c(c), lambda x: F.when(norm == 0, x.cast("double")).otherwise(x / norm))


def cosine_distance(a: Col, b: Col) -> Column:
    """1 - dot product clamped to -1..1, of unit vectors; different lengths are an error."""
    dot = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    same = F.size(_c(a)) == F.size(_c(b))
    return F.when(same, 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))).otherwise(F.raise_error(F.lit("vectors of different length")).cast("double"))


def encode_cursor(ts: Col, key: Col) -> Column:
    """URL-safe base64 of 'instant|key'; the instant in UTC to the microsecond, whatever the session's time zone."""
    micros = F.unix_micros(_c(ts))
    second, rest = F.floor(micros / 1_000_000).cast("long"), F.pmod(micros, F.lit(1_000_000))
    day = F.date_add(F.lit(datetime.date(1970, 1, 1)), F.floor(second / 86400).cast("int")).cast("string")
    of_day = F.pmod(second, F.lit(86400))
    clock = F.format_string("T%02d:%02d:%02d", F.floor(of_day / 3600), F.floor(of_day / 60) % 60, of_day % 60)
    raw = F.concat_ws("|", F.concat(day, clock, F.when(rest > 0, F.format_string(".%06d", rest)).otherwise(""), F.lit("+00:00")), _c(key).cast("string"))
    return F.translate(F.base64(F.encode(raw, "utf-8")), "+/", "-_")


def decode_cursor(c: Col) -> Column:
    """struct(ts, key) of a cursor."""
    raw = F.decode(F.unbase64(F.translate(_c(c), "-_", "+/")), "utf-8")
    return F.struct(F.to_timestamp(F.substring_index(raw, "|", 1)).alias("ts"), F.substring_index(raw, "|", -1).alias("key"))


def cursor_values(cursor: str) -> tuple[datetime.datetime, int]:
    """The instant and the key of a cursor; ValueError where it is none."""
    try:
        ts, key = base64.urlsafe_b64decode(cursor.encode("ascii")).decode().split("|", 1)
        return datetime.datetime.fromisoformat(ts), int(key)
    except ValueError as e:
        raise ValueError("not a cursor") from e


def explain_signal(kind: Col, evidence: Col) -> tuple[Column, Column]:
    """Title and sentence of a signal from its type and evidence map. The wording is fixed."""
    t, e = _c(kind), lambda k: F.coalesce(F.element_at(_c(evidence), k), F.lit("None"))
    timing = F.element_at(_c(evidence), "timing_kind")
    say = lambda text, *keys: F.format_string(text, *(e(k) for k in keys))
    title = (
        F.when(t == "PRICE_VARIANCE", "Invoice unit price variance vs purchase order")
        .when(t == "QUANTITY_VARIANCE", "Invoice quantity variance vs expected quantity")
        .when(t == "DUPLICATE_INVOICE", "Possible duplicate invoice identity")
        .when((t == "TIMING_ANOMALY") & (timing == "invoice_before_po"), "Invoice date precedes purchase order date")
        .when((t == "TIMING_ANOMALY") & (timing == "invoice_before_grn"), "Invoice date precedes goods receipt date")
        .when(t == "TIMING_ANOMALY", "Unusually long PO-to-invoice delay")
        .when(t == "VENDOR_SPIKE", "Invoice value above vendor historical baseline")
        .when(t == "REPEATED_MISMATCH", "Elevated vendor reconciliation exception rate")
        .otherwise("Procurement anomaly signal")
    )
    sentence = (
        F.when(t == "PRICE_VARIANCE", say("Invoice unit price %s differs from PO unit price %s (%s%% variance).", "invoice_unit_price", "po_unit_price", "variance_percent"))
        .when(t == "QUANTITY_VARIANCE", say("Invoiced quantity %s differs from expected quantity %s (%s%% variance).", "invoiced_quantity", "expected_quantity", "variance_percent"))
        .when(t == "DUPLICATE_INVOICE", say("Vendor has %s invoice records sharing normalized invoice number %s.", "duplicate_count", "normalized_invoice_number"))
        .when((t == "TIMING_ANOMALY") & (timing == "long_po_to_invoice_delay"), say("Invoice date is %s days after the purchase order date (threshold %s days).", "delay_days", "threshold_days"))
        .when((t == "TIMING_ANOMALY") & (timing == "invoice_before_grn"), "Invoice date precedes goods receipt (GRN) date.")
        .when(t == "TIMING_ANOMALY", "Invoice date precedes purchase order date.")
        .when(t == "VENDOR_SPIKE", say("Invoice value %s is %sx the vendor's recent baseline average %s (n=%s).", "current_value", "ratio", "baseline_average", "historical_invoice_count"))
        .when(t == "REPEATED_MISMATCH", say("Vendor has %s reconciliation exceptions across %s invoices (%s rate) in a %s-day window.", "exception_count", "invoice_count", "exception_rate", "window_days"))
        .otherwise("Deterministic anomaly signal detected.")
    )
    return title, sentence
