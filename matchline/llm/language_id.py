"""Language of web pages by Bayesian fusion of its text, markup, address suffix and host.

The text's likelihood comes from byte-trigram counts of texts of known language. The declared language of the markup
and the address suffix are conditioned on the language by soft counts: each page counts for each language as much as its
text says. Host priors are smoothed towards the domain's, those towards the suffix's, those towards all pages'; the
suffix speaks through them alone. All counts are grouped aggregates; a page's own share is taken out of its host's,
domain's, suffix's and declaration's before it meets them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import on_workers, raw_texts, slices, stored

BUCKETS = 1 << 14
#: Overlapping trigrams repeat each other's evidence; their log-likelihood counts by a third.
TEMPER = 1 / 3
#: Pseudo-counts of a parent's prior and of a declaration's or suffix's smoothing.
PRIOR_WEIGHT = 5.0
SMOOTH = 0.5

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_HTML_LANG = r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-z]{2,3})"


def visible(page: str) -> str:
    """A page's text without markup, scripts, styles and comments; entities are resolved."""
    return html.unescape(_HIDDEN.sub(" ", page))


def trigram_counts(raw: bytes) -> np.ndarray:
    """How often each of BUCKETS hashed byte trigrams occurs; blanks and digits count alike, A-Z as a-z."""
    x = np.frombuffer(b" " + raw.lower() + b" ", np.uint8)
    x = np.where((x < 64) & (x != 38), 32, x).astype(np.uint32)
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
    if len(x) < 3:
        return np.zeros(BUCKETS, np.int64)
    key = (x[:-2] * 65599 + x[1:-1]) * 65599 + x[2:]
    return np.bincount((key * np.uint32(2654435769)) >> np.uint32(18), minlength=BUCKETS)


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """docs(text, lang) -> languages and their log trigram probabilities (languages x BUCKETS), from all rows with both.

    A language is the first part of a tag: en-US and en_GB count as en. Every language gets a model. Tasks add up their
    counts; languages * BUCKETS sums at most reach the driver.
    """
    on_workers(docs.sparkSession)
    tag = F.lower(F.trim("lang"))
    first = F.trim(F.regexp_extract(tag, "^[^-_]*", 0))
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND trim(lang) <> ''").select(F.when(first == "", tag).otherwise(first).alias("lang"), "text")
    langs = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            by: dict[str, list[bytes]] = {}
            for lang, raw in zip(batch.column("lang").to_pylist(), raw_texts(batch)):
                by.setdefault(lang, []).append(raw)
            for lang, own in by.items():
                sums[lang] = sums.get(lang, 0) + trigram_counts(b" ".join(own))
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    table = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), BUCKETS))
    place = {lang: i for i, lang in enumerate(langs)}
    rows = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    counts[rows, np.asarray(table.column("bucket"), np.int64)] = np.asarray(table.column("n"), float)
    counts += SMOOTH
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def _evidence(pages: DataFrame, logp: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, and per language the text's log-likelihood and its softmax."""
    shared = pages.sparkSession.sparkContext.broadcast(logp)

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [TEMPER * (shared.value @ trigram_counts(visible(raw.decode()).encode())) for raw in raw_texts(batch)]
            ll = np.array(rows).reshape(batch.num_rows, -1)
            ll -= ll.max(axis=1, keepdims=True)
            q = np.exp(ll)
            q /= q.sum(axis=1, keepdims=True)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1))) for x in (ll, q)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "declared")), *lists], names=["page_id", "host", "declared", "ll", "q"])

    url = F.lower(F.coalesce(F.col("url").cast("string"), F.lit("")))
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1).alias("host"),
        F.lower(F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), _HTML_LANG, 1)).alias("declared"),
        F.col("html").cast("string").alias("text"),
    )
    rows = own.mapInArrow(text, "page_id long, host string, declared string, ll array<double>, q array<double>")
    return rows.withColumns({"domain": F.regexp_extract("host", r"([^.]+\.)?[^.]*$", 0), "suffix": F.regexp_extract("host", r"[^.]*$", 0)})


def _sums(n: int) -> Column:
    return F.array(*(F.sum(F.col("q")[i]) for i in range(n)))


def _plus(a: Column | str, b: Column | str, weight: float) -> Column:
    """(a + weight * b) / (sum of a + weight), for a distribution b."""
    total = F.aggregate(a, F.lit(0.0), lambda x, y: x + y) + weight
    return F.zip_with(a, b, lambda x, y: (x + weight * y) / total)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """pages(page_id, url, html), docs(text, lang) -> page_id, lang, probability, text_lang, declared, host.

    One row per input row, repeated and null ids included. Null or empty pages and addresses are evidence for nothing:
    they get the prior of their (empty) host. No training text: lang is null. Empty table: no rows. Other columns are
    ignored.
    """
    langs, logp = fit(docs)
    if not langs:
        nothing = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("long").alias("page_id"), nothing.alias("lang"), F.lit(0.0).alias("probability"), nothing.alias("text_lang"), nothing.alias("declared"), nothing.alias("host"))
    n = len(langs)
    rows = stored(_evidence(pages, logp))
    hosts = rows.groupBy("host", "domain", "suffix").agg(_sums(n).alias("host_n"))
    add = lambda c: F.array(*(F.sum(F.col(c)[i]) for i in range(n)))
    domains = hosts.groupBy("domain", "suffix").agg(add("host_n").alias("domain_n"))
    suffixes = domains.groupBy("suffix").agg(add("domain_n").alias("suffix_n"))
    declared = rows.where("declared <> ''").groupBy("declared").agg(_sums(n).alias("declared_n"))
    # Each level is small beside the rows below it; of the whole, n numbers reach the driver.
    all_n, any_n = (F.array(*(F.lit(float(x or 0.0)) for x in df.agg(add(c).alias("s")).first()["s"])) for df, c in ((suffixes, "suffix_n"), (declared, "declared_n")))
    levels = hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix").select("host", "host_n", "domain_n", "suffix_n")
    met = rows.join(levels, "host").join(declared, "declared", "left")
    less = lambda c: F.zip_with(c, "q", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    even = F.array(*(F.lit(1.0 / n) for _ in range(n)))
    prior = met.withColumn("all_p", _plus(less(all_n), even, 1.0))
    for level, above in (("suffix", "all"), ("domain", "suffix"), ("host", "domain")):
        prior = prior.withColumn(f"{level}_p", _plus(less(f"{level}_n"), F.col(f"{above}_p"), PRIOR_WEIGHT))
    # How much oftener a declaration comes with a language than declarations do on the whole.
    declared_l = F.zip_with(less("declared_n"), less(any_n), lambda x, y: F.log((x + SMOOTH) / (y + 2 * SMOOTH)))
    none = F.array(*(F.lit(0.0) for _ in range(n)))
    add2 = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = F.transform("host_p", lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    total = prior.withColumn("total", add2(add2(logs, F.col("ll")), F.coalesce(declared_l, none)))
    best = total.withColumn("top", F.array_max("total"))
    names = F.array(*(F.lit(x) for x in langs))
    return best.select(
        "page_id",
        F.element_at(names, F.array_position("total", F.col("top")).cast("int")).alias("lang"),
        (1 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("probability"),
        F.element_at(names, F.array_position("q", F.array_max("q")).cast("int")).alias("text_lang"),
        F.nullif("declared", F.lit("")).alias("declared"),
        "host",
    )
