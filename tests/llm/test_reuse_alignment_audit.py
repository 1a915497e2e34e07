"""Encoding by shared chunks, alignment of two tokenizers and the filter audit against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest

from matchline.llm import bpe_reuse, cross_alignment, filter_audit
from matchline.llm.perfect_hash import PerfectHash, build, shard_of

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string, name string, row long, key string, n long, kind int"
WORDS = ["alpha", "Beta", "<|endoftext|>", "<|start", "oftext|>", "<s>", "<unk>", "<0x41>", "日本語の文章です", "é", "é", "x" * 300, "12,5", "don't", "\xa0", "　", "\x1c", "#~^|", "🙂🙂", "ı", "İ", "a▁b", "\0", "\r\n", "the", "of"]
BETWEEN = [" ", " ", "\n", "", "\t", "  ", "   "]


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "k", 1, "k", 1, 7) for i, t, s in rows], SCHEMA)


def some_text(rng, n, words=WORDS):
    return "".join(rng.choice(words) + rng.choice(BETWEEN) for _ in range(n))


def mixed_rows(seed, n):
    rng = random.Random(seed)
    clean = [w for w in WORDS if "▁" not in w]
    shared = [some_text(rng, 50, clean) for _ in range(5)]
    rows = [(i, "".join(rng.choice([rng.choice(shared), some_text(rng, 20, clean if i % 3 else WORDS)]) for _ in range(rng.randrange(6))), "s") for i in range(n)]
    return [*rows, (1, None, "s"), (None, "", None), (None, " ", "s"), (5, "trail ", "s"), (1, shared[0], "s"), (1, shared[0], "s"), (None, shared[1] * 200, "s"), (9, "日本" * 20000, "s")]


@pytest.mark.parametrize("bits", [3, 6, 10])
def test_encoding_by_shared_chunks_equals_the_library(spark, bits):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = mixed_rows(bits, 80)

    def whole(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    docs = table(spark, rows)
    got = bpe_reuse.encode_texts(docs, path, bits).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *whole(x))) for i, x, _ in rows)
    own = bpe_reuse.documents(docs)
    kinds = {r.kind: r["count"] for r in bpe_reuse.parts(own, path, spark.sparkContext.broadcast(bpe_reuse.shared_flags(own, bits)), bits).groupBy("kind").count().collect()}
    assert kinds[bpe_reuse.REFERENCE] > kinds[bpe_reuse.CHUNK] > 0


def test_encoding_an_empty_table(spark):
    assert bpe_reuse.encode_texts(table(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_references_and_segments_make_the_text():
    rng = random.Random(2)
    for _ in range(200):
        raw = some_text(rng, 30).encode()
        edges, names = bpe_reuse.chunks(raw, 4)
        assert b"".join(raw[a:b] for a, b in zip(edges, edges[1:])) == raw
        blank = bpe_reuse.blanks(raw)
        own = bpe_reuse.references(len(raw), blank, edges, names, [rng.random() < 0.5 for _ in names])
        at = 0
        for r in own:
            assert at <= r.begin <= r.inner < r.until <= r.end
            # No word crosses where the text goes over to a chunk's encoding and back.
            assert r.inner == 0 or raw[r.inner - 1 : r.inner].isspace() or raw[r.inner : r.inner + 1].isspace()
            assert r.until == len(raw) or raw[r.until - 1 : r.until].isspace() or raw[r.until : r.until + 1].isspace()
            at = r.end
        assert all(w in raw for w in bpe_reuse.windows(raw, blank, own))


def test_chunks_of_a_passage_are_the_same_wherever_it_stands():
    rng = random.Random(4)
    passage = some_text(rng, 400).encode()
    names = [set(bpe_reuse.chunks(some_text(rng, k).encode() + passage, 7)[1]) for k in (0, 13, 57)]
    assert len(names[0] & names[1] & names[2]) > len(names[0]) * 0.9


def test_perfect_hash_is_minimal_and_verified(spark):
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 20_000))
    rows = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, shard_of(keys, 5))], "key long, shard long")
    hashed = PerfectHash.of(build(rows, 5).orderBy("shard").collect(), 5)
    assert sorted(hashed.numbers(keys).tolist()) == list(range(len(keys)))
    assert set(hashed.numbers(keys + 1)[~np.isin(keys + 1, keys)].tolist()) == {-1}
    part = PerfectHash.of(build(rows.where("shard in (1, 3)"), 5).orderBy("shard").collect(), 5)
    inside = np.isin(shard_of(keys, 5), (1, 3))
    assert (part.numbers(keys)[~inside] == -1).all() and sorted(part.numbers(keys)[inside].tolist()) == list(range(inside.sum()))


def aligned_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    t.encode_special_tokens = True
    letters = cross_alignment._byte_alphabet()
    docs = []
    for i, x, _ in rows:
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)) if x else ([], [])
        raw_a = [bytes(letters[c] for c in t.id_to_token(k)) for k in a]
        raw_b = [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not x or not b"".join(raw_a) == (" " + x).encode() == b"".join(raw_b):
            a, b, raw_a, raw_b = [], [], [], []
        end_a, end_b = list(itertools.accumulate(map(len, raw_a))), list(itertools.accumulate(map(len, raw_b)))
        owner = [None] * (end_b[-1] if end_b else 0)
        for k, (e, r) in enumerate(zip(end_b, raw_b)):
            owner[e - len(r) : e] = [k] * len(r)
        links = [(a[k], b[m]) for k, (e, r) in enumerate(zip(end_a, raw_a)) for m in sorted(set(owner[e - len(r) : e]))]
        groups, p, q = [], 0, 0
        for c in sorted(set(end_a) & set(end_b)):
            k, m = end_a.index(c) + 1, end_b.index(c) + 1
            groups.append(",".join(map(str, a[p:k])) + "|" + ",".join(map(str, b[q:m])))
            p, q = k, m
        docs.append((i, len(a), len(b), links, groups))
    held = collections.Counter(x for d in docs for x in set(d[3]))
    top = collections.defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return [
        (i, na, nb, len(g), len(l), sum(held[x] == top[x[0]] for x in l), sum(held[x] for x in l), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, l, g in docs
    ]


@pytest.mark.parametrize("shard_keys", [1 << 15, 200])
def test_alignment_equals_brute_force(spark, monkeypatch, shard_keys):
    monkeypatch.setattr(cross_alignment, "SHARD_KEYS", shard_keys)  # 200: several blocks of one shard each
    rows = [(i, x[:600] if x and len(x) > 3000 else x, s) for i, x, s in mixed_rows(5, 60)]
    got = cross_alignment.align(table(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), 1 << 22 if shard_keys > 200 else 1)
    want = aligned_by_hand(rows)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert 0 < sum(not w[1] for w in want) < len(want) / 2


def test_alignment_of_an_empty_table(spark):
    assert cross_alignment.align(table(spark, []), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def audited_by_hand(rows, labels):
    by_text = collections.defaultdict(list)
    for i, x, _ in rows:
        if i is not None:
            by_text[x or ""].append(i)
    docs = []
    for i, x, source in rows:
        x = x or ""
        words = x.encode().split()
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in x) > 5 * len(x))
        fails += "D" * any(c in "#$%&*|" for c in x) + "E" * (i is not None and i > min(by_text[x]))
        docs.append((source or "", fails, any(k == i and q == 1 for k, q, _ in labels if k is not None), any(k == i and t == 1 for k, _, t in labels if k is not None)))
    out, removed_by = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            here = [d for d in docs if d[0] == part]
            for step, c in enumerate(order, 1):
                gone = [d for d in docs if d[0] == part and set(d[1]) & set(order[: step - 1])]
                hit = [d for d in here if c in d[1]]
                here = [d for d in here if c not in d[1]]
                out[part, order, step] = (len(here), len(hit), sum(c in d[1] for d in gone), sum(d[1] == c for d in docs if d[0] == part), sum(d[2] for d in hit), sum(d[3] for d in hit))
                removed_by[part, c] += len(hit)
    return {(*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(6)
    words = ["low", "Cap", "UP", "more", "#", *(f"w{i}" for i in range(60))]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([10, 55, 90]))) for _ in range(25)] + [None, "", "é" * 30, "word " * 20000]
    rows = [(rng.randrange(60), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(120)]
    rows += [rows[0], rows[0], (None, texts[0], "a"), (None, texts[0], "a"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(40)] + [(3, 1, 0), (None, 1, 1)]
    got = filter_audit.audit(table(spark, rows), spark.createDataFrame([(*x, "k", 3) for x in labels], "doc_id long, quality int, toxic int, text string, n long"))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == audited_by_hand(rows, labels)
    assert filter_audit.audit(table(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_intervals_cover_each_order_once():
    for mask, step in itertools.product(range(1, 32), range(1, 6)):
        own = [r for r in filter_audit.intervals() if r[:2] == (mask, step)]
        for rank, order in enumerate(filter_audit.ORDERS):
            flags = [r[4:] for r in own if r[2] <= rank < r[3]]
            hits = [bool(mask & filter_audit.BIT[x]) for x in order[:step]]
            want = (not any(hits), hits[-1] and not any(hits[:-1]), hits[-1] and any(hits[:-1]), hits[-1] and mask == filter_audit.BIT[order[step - 1]])
            assert flags == ([tuple(map(int, want))] if any(want) else [])


def test_rows_without_an_id_hide_no_document(spark, tmp_path):
    import corpus_pipeline

    words = " ".join(f"word{i}" for i in range(80))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
    for top in (42, (1 << 63) - 1):
        docs = spark.createDataFrame([(7, "", "en", "s", 0), (top, words, "en", "s", 1), (None, None, "en", "s", None), (None, "other " + words[::-1], "en", "s", 1), (None, words, "en", "s", 1)], schema)
        left = corpus_pipeline.near_duplicates(spark, docs, "")
        assert left.count() == 3 and (top > 42 or ids(left) == [(False, 7), (False, 42), (True, 0)])  # ids win where there is room above them
        spark.createDataFrame([(1, "a benchmark text of quite other words than those that are here")], "item_id long, text string").write.mode("overwrite").parquet(f"file://{tmp_path}/benchmark.parquet")
        assert corpus_pipeline.decontaminated(spark, docs, f"file://{tmp_path}").count() == 5
