"""Operators against brute force, on small rows with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import random
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchline.llm import decontamination, language_id, line_dedup, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, sharding, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    None, "", " ", "One two  three\n\nfour ", "a<|endoftext|> b", "don't we'll\t12,34 !!", "é  ü\x1c x \x00 y", "word " * 3000,
    "The quick brown fox jumps over the lazy dog near the river bank today.\nThe quick brown fox jumps over the lazy dog near the river bank today.", "One two  three\n\nfour ",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, unit string, n long"


def docs(spark, texts=TEXTS, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "u", 1) for i, t in zip(ids, texts)], SCHEMA)


def own_words(t):
    return (t or "").encode().lower().split()


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = token_counts.token_counts(docs(spark, ids=[*range(9), 3]), path, 5).collect()
    want = sorted((len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 5) for x in TEXTS)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(docs(spark, []), path).count() == 0


def test_packing_round_trip_and_bound(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    pieces = packing.pieces(docs(spark), path)
    rows = packing.pack(pieces).collect()
    for i, x in enumerate(TEXTS):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want = [(k, s, len(c := ids[s : s + 2048]), zlib.crc32(np.array(c, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == packing.lower_bound(np.bincount([r.length for r in rows], minlength=2049), 2048)


def test_bounds_hold_and_exchange_helps(spark):
    assert packing.lower_bound(np.bincount([6, 6, 6], minlength=11), 10) == 3
    assert packing.lower_bound(np.bincount([4] * 5, minlength=11), 10) == 3
    sizes = [int(x) for x in np.random.default_rng(1).integers(300, 1200, 400)]
    items = spark.createDataFrame([(i, 0, 0, s, i) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    n = {k: packing.certificate(items, packing.pack(items, partition=20, rounds=k)) for k in (0, 3)}
    assert n[3]["lower_bound"] <= n[3]["sequences"] <= n[0]["sequences"]


def brute_tree(train, total, kinds, least, gain, discount=0.5):
    """The suffix tree over tuples of words: log10 probability of a word after others, by the rules as stated."""
    counts = collections.Counter(tuple(t[i : i + k]) for t in train for k in range(1, len(t) + 1) for i in range(len(t) - k + 1))
    root = lambda w: math.log10((counts[(w,)] + 1) / (total + kinds + 1))
    back, logp, kept = {}, {}, {(w,): True for (w, *more), n in counts.items() if n >= least and not more}

    def after(context, word):
        while context and context not in back:
            context = context[1:]
        if not context:
            return root(word)
        return logp[(*context, word)] if (*context, word) in logp else back[context] + after(context[1:], word)

    while True:
        nexts = collections.defaultdict(dict)
        for seq, n in counts.items():
            if len(seq) > 1 and len(seq) == len(next(iter(kept))) + 1 and n >= least and kept.get(seq[1:]) and seq[:-1] in kept:
                nexts[seq[:-1]][seq[-1]] = n
        grown, found = {}, {}
        for c, own in nexts.items():
            t = counts[c]
            rest = 1 - sum(n - discount for n in own.values()) / t
            left = 1 - sum(10 ** after(c[1:], w) for w in own)
            ok = rest > 1e-9 and left > 1e-9 and sum(n * math.log(n / t / 10 ** after(c[1:], w)) for w, n in own.items()) + (t - sum(own.values())) * math.log(rest / left) > gain * len(own)
            if ok:
                found[c] = math.log10(rest / left)
                logp |= {(*c, w): math.log10((n - discount) / t) for w, n in own.items()}
            grown |= {(*c, w): ok for w in own}
        back |= found
        kept = grown
        if not found:
            return after, back


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = ["a b a b c", "A b", None, "b a\x0bb a", "c" * 100 + " a", "a b a b"] * 4
    texts += [" ".join(rng.choice(list("abcde"), 12, p=[0.4, 0.3, 0.1, 0.1, 0.1])) + " then the long road goes on to the far hills" * int(k % 2) for k in range(120)]
    texts += ["one two three four", "five two three six"] * 15
    rows = lm_scoring.lm_scores(docs(spark, texts), least=2, gain=1.0).collect()
    tokens = [[*own_words(t), b"\n"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    train = [t for t, h in zip(tokens, held) if not h]
    known = collections.Counter(w for t in train for w in t)
    n, v = sum(known.values()), len(known)
    after, states = brute_tree(train, n, v, 2, 1.0)
    assert max(map(len, states)) > 1 and len(rows) == len(texts)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(w in known for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((known[w] + 1) / (n + v + 1)) for w in own), abs_tol=1e-9)
        assert math.isclose(r.score, sum(after(tuple(own[:i]), w) for i, w in enumerate(own)), abs_tol=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    # In every state the probabilities of the known words and of one unknown word add up to 1.
    for c in [(), *states]:
        assert math.isclose(sum(10 ** after(c, w) for w in [*known, b"?"]), 1, abs_tol=1e-9)
    assert lm_scoring.lm_scores(docs(spark, [])).count() == 0
    only = lm_scoring.lm_scores(docs(spark, ["x y", None], [None, None])).collect()
    assert sorted(r.n_tokens for r in only) == [1, 3] and all(r.doc_id is None and not r.held_out for r in only)


def test_held_out_rows_teach_nothing(spark):
    fold = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts = {i: "red green blue red green blue" for i in range(60)}
    one = lm_scoring.lm_scores(docs(spark, list(texts.values()))).where("NOT held_out").collect()
    two = lm_scoring.lm_scores(docs(spark, [f"quite another text {i} {i}" if i in fold else t for i, t in texts.items()])).where("NOT held_out").collect()
    assert fold and sorted((r.doc_id, r.score) for r in one) == sorted((r.doc_id, r.score) for r in two)


def test_places_of_texts_make_one_row_a_length(spark, monkeypatch):
    texts = [" ".join(f"w{i % 40}" for i in range(k, k + 40)) for k in range(64)]  # common words and pairs, in every task
    frame, made = type(spark.range(1)), []
    plain = frame.mapInArrow

    def counted(df, func, schema, *more, **named):
        if df.columns != ["text"]:
            return plain(df, func, schema, *more, **named)
        rows = spark.sparkContext.accumulator(0)
        made.append(rows)

        def run(batches):
            for batch in func(batches):
                rows.add(batch.num_rows)
                yield batch

        return plain(df, run, schema, *more, **named)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    train = docs(spark, texts).select("text").repartition(16)
    vocab = lm_scoring.vocabulary(train)
    weights, longest = lm_scoring.fit(train, vocab, 64 * 41, 41, 2)
    assert longest > 2 and weights.count() > 0
    made = [rows.value for rows in made[1:]]  # but the vocabulary's
    assert len(made) == longest - 1 and made[0] > 16 * 40
    assert all(rows <= 64 * (40 - k) for k, rows in enumerate(made))


def test_quality_ledger(spark):
    texts = [*TEXTS, "x y z " * 40, "good words here " + " ".join(f"w{i}" for i in range(60)), "# " * 60]
    rows = quality_rules.ledger(docs(spark, texts))
    for r in rows.collect():
        w = (texts[r.doc_id] or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")
        w = [x for x in w if x]
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
    kept = quality_rules.apply_policy(rows, "v1")
    assert [r.doc_id for r in kept.where("kept").collect()] == [11]
    ablated = {r.rule: (r.n_failed, r.n_alone) for r in quality_rules.ablation(rows).collect()}
    assert ablated["few_words"][0] == kept.where("n_words < 50").count() and ablated["repeated_windows"][1] >= 1


LONG = "this line is certainly longer than forty code points"


def brute_lines(rows):
    held = collections.defaultdict(set)
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    hot = {k: max(v) for k, v in held.items() if len(v) >= 5}
    return sorted((i, "\n".join(x for x in (t or "").split("\n") if hot.get(key(x), i) == i)) for i, t in rows)


def test_line_dedup_and_reversal(spark):
    rows = [(i, f"{LONG if i % 2 else '  ' + LONG.upper()}\nown {i}\n{'é' * 39}\n{'é' * 40}") for i in range(6)] + [(6, None), (7, ""), (8, LONG)]
    frame = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    assert sorted((r.doc_id, r.text) for r in line_dedup.line_dedup(frame).collect()) == brute_lines(rows)
    refs = line_dedup.references(frame)
    fewer = line_dedup.update_references(refs, removed=frame.where("doc_id IN (0, 1, 2, 8)"))
    assert line_dedup.repeated(fewer).count() == 0  # the lines come back
    again = line_dedup.update_references(fewer, added=frame.where("doc_id IN (0, 1, 2, 8)"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, refs.collect()))
    before, after = line_dedup.repeated(refs), line_dedup.repeated(fewer)
    table = line_dedup.update_filters(line_dedup.filters(before, 1), 1, before, after).first()
    keys = [bytes(r.key) for r in before.collect()]
    assert not line_dedup.CuckooFilter.from_bytes(bytes(table["filter"])).contains(keys).any()


def test_line_dedup_by_changes_equals_one_load(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(30)]), "\n".join(f"line {rng.randrange(25)} " + "x" * 40 for _ in range(rng.randrange(6)))) for _ in range(60)]
    frame = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    want = sorted(((r.doc_id or -1, r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(frame).collect()))
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    monkeypatch.setattr(line_dedup, "BLOCK_SHARDS", 2)  # several blocks of filters
    third = F.coalesce(F.col("doc_id"), F.lit(2)) % 3
    state = line_dedup.load(frame.where(third == 0))
    state = line_dedup.change(state, added=frame.where(third != 0))
    fewer = line_dedup.change(state, removed=frame.where(third == 1).select("doc_id"))
    left = sorted(((r.doc_id or -1, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(frame.where(third != 1), fewer).collect()))
    assert left == sorted(((r.doc_id or -1, r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(frame.where(third != 1)).collect()))
    state = line_dedup.change(fewer, added=frame.where(third == 1))
    assert sorted(((r.doc_id or -1, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(frame, state).collect())) == want
    assert sorted(map(tuple, state.counts.collect())) == sorted(map(tuple, line_dedup.load(frame).counts.collect()))
    empty = frame.where("false")
    assert line_dedup.drop_lines(empty, line_dedup.change(line_dedup.load(empty), added=empty, removed=empty)).count() == 0


def test_cuckoo_filter():
    keys = [bytes(np.random.default_rng(i).bytes(16)) for i in range(3000)]
    own = line_dedup.CuckooFilter.of(keys)
    assert own.contains(keys).all() and own.contains([bytes(np.random.default_rng(-1 % 2**31 + i).bytes(16)) for i in range(9000, 12000)]).mean() < 0.01
    own.delete(keys[:1500])
    assert own.contains(keys[1500:]).all() and own.contains(keys[:1500]).mean() < 0.01


def test_near_classes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for e in range(4):
            own = list(base)
            for at in rng.integers(0, 120, e):
                own[at] = f"edit{at}"
            texts.append(" ".join(own))
    texts += ["", None, texts[0], "short text", "short text", "word " * 200]
    sets = []
    for t in texts:
        w = own_words(t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
        sets.append({(s, i) for s, n in c.items() for i in range(n)})
    group = list(range(len(texts)))

    def top(x):
        return x if group[x] == x else top(group[x])

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs(spark, texts)).collect()}
    assert got == {i: top(i) for i in range(len(texts))}
    assert near_dedup.near_classes(docs(spark, [])).count() == 0
    assert not near_dedup.aligned(np.arange(10), np.arange(10)[::-1]) and near_dedup.aligned(np.arange(10), np.arange(1, 10))


def edited(rng, words, n):
    """words with n of them replaced, at places that share no shingle."""
    own = list(words)
    for at in rng.choice(np.arange(5, len(words) - 5, 6), n, replace=False):
        own[at] = f"e{rng.integers(1 << 40)}"
    return own


def test_near_classes_of_stars(spark):
    rng = np.random.default_rng(11)
    texts, want = [], []
    for copies in (30, 100):
        base = [f"w{x}" for x in rng.integers(0, 1 << 30, 200)]
        own = [base, *(edited(rng, base, 3) for _ in range(copies))]  # 0.86 to the original, 0.73 to each other
        want += [len(texts)] * len(own)
        texts += [" ".join(w) for w in own]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs(spark, texts)).collect()}
    assert got == dict(enumerate(want))


def test_near_classes_within_buckets_of_like_texts(spark):
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 1 << 30, 200)]
    group = {}
    while len(group) < 300:  # 0.66 to 0.79 to each other: no two are edited at the same places
        own = edited(rng, base, 4)
        group.setdefault(tuple(i for i, w in enumerate(own) if w[0] == "e"), own)
    group = list(group.values())

    def sketches(texts):
        words = near_dedup.split_words([" ".join(t).encode() for t in texts])
        return near_dedup.order_sketches(*near_dedup.shingles(words.hashes, words.starts))

    rows, pairs = sketches(group), []
    for i in range(8):  # beside some a text at 0.81 that shares few sketches with it, in buckets of many
        near = [edited(rng, group[i], 4) for _ in range(1500)]
        own = sketches(near)
        crowded = (rows == rows[i]).sum(axis=0) > 20
        shared = (own == rows[i]).sum(axis=1)
        fit = np.flatnonzero((((own == rows[i]) & ~crowded).sum(axis=1) == 0) & (shared > 0))
        if len(fit):
            pairs.append((i, len(group)))
            group.append(near[fit[np.argmin(shared[fit])]])
    assert len(pairs) > 3
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs(spark, [" ".join(t) for t in group])).collect()}
    assert got == {i: i for i in range(len(group))} | {b: a for a, b in pairs}


def test_pairs_of_a_group_of_edits_are_made_once(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base, group, places = [f"w{x}" for x in rng.integers(0, 1 << 30, 200)], [], []
    for _ in range(600):  # two at 0.81 if two of their three edits are at like places, else at 0.77 at most
        group.append(edited(rng, base, 3))
        places.append({i for i, w in enumerate(group[-1]) if w[0] == "e"})
    want = list(range(len(group)))
    for i in range(len(group)):
        for j in range(i):
            if len(places[i] & places[j]) > 1 and want[i] != want[j]:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if c == old else c for c in want]
    frame, inside, made = type(spark.range(1)), [], []
    distinct, unchecked = frame.distinct, near_dedup._unchecked

    def counted(df):
        if inside and df.columns == ["a", "b"]:
            made.append((df.count(), distinct(df).count()))
        return distinct(df)

    def entered(*args):
        inside.append(1)
        out = unchecked(*args)
        inside.pop()
        return out

    monkeypatch.setattr(frame, "distinct", counted)
    monkeypatch.setattr(near_dedup, "_unchecked", entered)
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs(spark, [" ".join(t) for t in group])).collect()}
    assert got == dict(enumerate(want))
    print("rows of pairs, pairs:", made)
    rows, pairs = (sum(x) for x in zip(*made))
    assert pairs and rows <= 1.5 * pairs  # a pair shares a dozen of its rarest shingles
    # Some meet first, and what they join needn't meet again.
    linked = sum(len(places[i] & places[j]) > 1 for i in range(len(group)) for j in range(i))
    print("links:", linked)
    assert len(made) > 1 and pairs < linked


def test_decontamination(spark):
    item = " ".join(f"term{i}" for i in range(30))
    edited = " ".join("new" if i % 7 == 3 else f"term{i}" for i in range(30))
    filler = " ".join(f"other{i}" for i in range(80))
    texts = [f"{filler} {item} {filler}", f"{filler} {edited}", filler, None, "", "term1 term2 term3 of another text", item] + [f"{item} {i}" for i in range(60)]
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, doc_id string")
    rows = decontamination.contaminated(docs(spark, texts), bench).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 6, *range(7, 67)]
    first = next(r for r in rows if r.doc_id == 0)
    assert (first.item_id, first.score, first.first_word, first.end_word) == (1, 1.0, 80, 110)
    assert decontamination.contaminated(docs(spark, []), bench).count() == 0


def brute_alignment(a, b):
    """Best score of a local alignment: match 2, mismatch and gap -1."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, *row)
    return best


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(12)]
    items = [[f"i{k}w{j}" for j in range(20)] + common[:8] + [f"i{k}v{j}" for j in range(12)] for k in range(6)] + [["two", "words"]]
    texts = []
    for t in range(150):
        own = [f"f{x}" for x in rng.integers(0, 400, 60)]
        if t % 3:
            copy = list(items[t % 6])
            for at in rng.integers(0, 40, t % 17):  # replaced, dropped and added words
                copy[at % len(copy) : at % len(copy) + int(at % 2)] = [f"e{at}"] * int(at % 3)
            own[30:30] = copy
        texts.append(" ".join(own + common * (t % 2)))
    texts += [None, "", "two words", " ".join(items[0] * 3)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(3, "another text of the same item"), (None, "x y z"), (9, None)], "item_id long, text string")
    own = [(t or "").split() for t in texts]
    want = {(d, k): s / (2 * len(x)) for d, t in enumerate(own) for k, x in enumerate(items) if (s := brute_alignment(x, t)) >= len(x)}
    for rare in (50, 1 << 60):  # with and without judging rarity: the same passages
        rows = decontamination.contaminated(docs(spark, texts), bench, rare_docs=rare).collect()
        assert {(r.doc_id, r.item_id): r.score for r in rows} == want
    none = decontamination.contaminated(docs(spark, ["two words", "two words"], [None, None]), bench).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in none] == [(None, 6, 1.0)]
    assert decontamination.contaminated(docs(spark, texts), bench.where("false")).count() == 0


def test_classifier_on_held_out_rows(spark):
    rng = np.random.default_rng(5)
    good = [" ".join(rng.choice(["river", "bank", "stone", "house", "light", "green", "under"], 60)) for _ in range(60)]
    bad = [" ".join(x + "$$$" for x in rng.choice(["buy", "win", "free", "click"], 60)) for _ in range(60)]
    texts = [x for pair in zip(good, bad) for x in pair] + [None, ""]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)], "doc_id long, quality int")
    rows = quality_classifier.cross_scored(docs(spark, texts), labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id < 120]
    assert held and all(r.predicted == 1 - r.doc_id % 2 for r in held) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_language_of_pages(spark):
    known = spark.createDataFrame([("the house and the river", "en"), ("das haus und der fluss", "de"), (None, "fr"), ("x", None)] * 5, "text string, lang string")
    pages = spark.createDataFrame(
        [(1, "http://a.example.com/x", "<html lang='en'><script>das und</script><p>the river &amp; the house</p>"), (2, "http://b.example.de", "<html lang=de><p>der fluss und das haus</p>"), (3, None, None), (1, "x", "")],
        "page_id long, url string, html string",
    )
    rows = language_id.identify(pages, known).collect()
    assert sorted((r.page_id, r.lang) for r in rows if r.text_lang and r.host)[:2] == [(1, "en"), (2, "de")] and len(rows) == 4
    assert all(0 < r.probability <= 1.0000001 for r in rows)


def test_languages_equal_brute_force(spark):
    known = [("the house and the river", "en"), ("das haus und der fluss", "de"), ("la maison et le fleuve", "fr")] * 4
    hosts = ["a.x.de", "a.x.de", "b.x.de", "c.y.com", "c.y.com", "", "alone.org"]
    bodies = ["das und der", "the and", "haus", "la maison", "", "river and", "x"]
    tags = ["de", "de", "", "fr", "en", "", "qq"]
    pages = [(i, f"http://{h}/p" if h else None, f"<html data-lang='zz'{f' lang={t}' if t else ''}><p>{b}</p>", "c") for i, (h, b, t) in enumerate(zip(hosts, bodies, tags))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    train = spark.createDataFrame(known, "text string, lang string")
    langs, logp = language_id.fit(train)
    ll = [language_id.TEMPER * (logp @ language_id.trigram_counts(language_id.visible(p[2]).encode())) for p in pages]
    q = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in ll]
    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    rows = {r.page_id: r for r in language_id.identify(frame, train).collect()}
    for i, h in enumerate(hosts):
        total = lambda same: np.maximum(sum((q[j] for j in range(len(hosts)) if same(j)), np.zeros(3)) - q[i] * bool(same(i)), 0)  # noqa: E731, B023
        p = np.full(3, 1 / 3)
        for same, weight in ((lambda j: True, 1.0), (lambda j: suffix(hosts[j]) == suffix(h), 5.0), (lambda j: domain(hosts[j]) == domain(h), 5.0), (lambda j: hosts[j] == h, 5.0)):  # noqa: B023
            own = total(same)
            p = (own + weight * p) / (own.sum() + weight)
        score = np.log(p) + ll[i] - ll[i].max()
        if tags[i]:
            score = score + np.log((total(lambda j: tags[j] == tags[i]) + 0.5) / (total(lambda j: bool(tags[j])) + 1))  # noqa: B023
        e = np.exp(score - score.max())
        assert (rows[i].lang, rows[i].declared) == (langs[int(e.argmax())], tags[i] or None) and math.isclose(rows[i].probability, 1 / e.sum(), rel_tol=1e-9)
    assert language_id.identify(frame.where("false"), train).count() == 0


def test_labels_that_disagree_teach_nothing(spark):
    texts = ["river bank stone " * 30, "$$$ buy free " * 30, "river bank stone light " * 30, "win click $$$ " * 30] * 10
    rows = [(i, 1 - i % 2) for i in range(40)]
    both = [quality_classifier.fit(docs(spark, texts), spark.createDataFrame(x, "doc_id long, quality int")) for x in (rows[2:], [(0, 1), (0, 0), (1, 0), (1, 1), *rows[2:]])]
    assert both[0] == both[1]
    empty = quality_classifier.cross_scored(docs(spark, []), spark.createDataFrame(rows, "doc_id long, quality int"))
    assert empty.count() == 0


def test_every_language_gets_a_model(spark):
    names = [f"{a}{b}" for a in "abcdefghijklmno" for b in "abcdefghijklmno"]
    rows = [(f"{n}qx {n}zv {n}kj", n) for n in names] + [("oosun oomoon", "OO-Latn"), ("oosea", "oo_XY"), ("dash", "-")]
    langs, logp = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(langs) == sorted([*names, "-"]) and logp.shape[0] == len(names) + 1
    page = spark.createDataFrame([(1, "http://a.example", "<p>nnqx nnzv nnkj</p>")], "page_id long, url string, html string")
    assert [r.text_lang for r in language_id.identify(page, spark.createDataFrame(rows, "text string, lang string")).collect()] == ["nn"]


def test_shards_compact_and_conflict(spark, tmp_path):
    store = sharding.shard_table(spark, docs(spark), f"file://{tmp_path}/a", arrivals=3, rows=1)
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(len(TEXTS)))
    now = store.manifest()
    assert sum(s["rows"] for s in now["shards"]) == len(TEXTS)
    store.commit(now["version"], now["shards"], now["schema"])
    with pytest.raises(sharding.Conflict):
        store.commit(now["version"], [], now["schema"])
    assert store.version() == now["version"] + 1 and store.placed().count() == len(TEXTS)
    with pytest.raises(ValueError):
        store.append(docs(spark).select("doc_id"))


def test_tiers_and_sizes_follow_the_rules(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/t", target_bytes=20_000)
    frame = spark.range(900).selectExpr("id AS doc_id", "sha2(cast(id AS string), 256) AS text")
    for i in range(9):
        store.append(frame.where(f"doc_id % 9 = {i}"), rows=20)
        version = store.compact()
        shards = store.manifest(version)["shards"]
        counts = collections.Counter(s["tier"] for s in shards)
        assert all(n < store.fan for t, n in counts.items() if t) and all(s["tier"] <= store.tier(s["bytes"]) for s in shards)
    assert sum(s["rows"] for s in shards) == 900 and len(shards) < 900 / 20
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, frame.collect()))
    assert store.tier(20_000) == 0 and store.tier(2_500) == 1 and store.tier(100) == 4


def test_two_writers_lose_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    one, two = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    part = lambda a, b: docs(spark, [f"text {i}" for i in range(a, b)], list(range(a, b)))
    for i in range(4):
        one.append(part(5 * i, 5 * i + 5))
    merge, uncommitted = one._merge, two._write(part(100, 110))

    def meanwhile(shards, schema):
        new = merge(shards, schema)
        two.append(part(50, 60))  # another writer commits during the merge
        one._merge = merge
        return new

    one._merge = meanwhile
    one.compact()
    one.vacuum()
    two.commit(two.version(), [*two.manifest()["shards"], *uncommitted], two.manifest()["schema"])
    assert sorted(r.doc_id for r in one.read().collect()) == [*range(20), *range(50, 60), *range(100, 110)]
    newest = one.version()
    assert one.read(newest - 1).count() == 30  # the version before is kept
    one.vacuum(keep=1, orphan_s=0)
    assert one.read().count() == 40


def test_shards_of_an_empty_table(spark, tmp_path):
    store = sharding.shard_table(spark, docs(spark, []), f"file://{tmp_path}/e")
    assert store.read().count() == 0 and store.read().columns == docs(spark, []).columns
    assert store.placed().columns == [*docs(spark, []).columns, "shard", "tier"]
    clash = docs(spark, ["a"], [None]).withColumn("shard", F.lit("x")).withColumn("file", F.lit("y"))
    own = sharding.shard_table(spark, clash, f"file://{tmp_path}/c")
    assert [(r.doc_id, r.shard, r.file) for r in own.placed().collect()] == [(None, 0, "y")]


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline as P

    body = lambda i: " ".join(f"w{i}x{k}" for k in range(80))
    frame = docs(spark, [body(0), body(0), body(1), "too short", None], [1, 2, 3, 4, 5]).select(*P.COLUMNS)
    out = P.quality(spark, frame, "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3] and out.columns == list(P.COLUMNS)
    out = P.near_duplicates(spark, P.lines(spark, out, ""), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3] and sorted(out.columns) == sorted(P.COLUMNS)
    assert P.packed(spark, out, "").select(F.countDistinct("doc_id")).first()[0] == 2


def test_pipeline_keeps_rows_of_repeated_ids(spark, tmp_path):
    import corpus_pipeline as P

    body = lambda i: " ".join(f"w{i}x{k}" for k in range(80))
    item = " ".join(f"term{k}" for k in range(30))
    frame = docs(spark, [body(0), body(1), body(1), body(2), body(2), body(3), body(3), f"{body(4)} {item}", body(5)], [7, 7, 9, None, None, 3, 3, 4, 4]).select(*P.COLUMNS)
    out = P.near_duplicates(spark, frame, "")
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(7, body(0)), (7, body(1)), (0, body(2)), (3, body(3)), (4, f"{body(4)} {item}"), (4, body(5))])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    clean = P.decontaminated(spark, out, f"file://{tmp_path}")
    assert sorted((r.doc_id or 0) for r in clean.collect()) == [0, 3, 7, 7] and clean.columns == list(P.COLUMNS)
    frame.write.parquet(f"file://{tmp_path}/documents.parquet")
    packed = P.run(spark, f"file://{tmp_path}")
    assert sorted((r.doc_id or 0) for r in packed.where("piece = 0").collect()) == [0, 3, 7, 7]
    none = docs(spark, []).select(*P.COLUMNS)
    for _, stage in P.STAGES:
        none = stage(spark, none, f"file://{tmp_path}")
        assert none.count() == 0
        none = none if "text" in none.columns else docs(spark, []).select(*P.COLUMNS)
