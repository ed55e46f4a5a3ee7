"""The language model: its counts and base against brute force, its shares, what it learns, and what it must not see."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")) + [None]


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base(rows):
    counts = Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return [
        (i, out(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)))
        for i, t in rows
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).selectExpr("*", "1 AS block", "2 AS part", "3 AS held_out", "4 AS n", "5 AS kind").repartition(3)


def corpus(n=60, seed=4):
    rng = random.Random(seed)
    tongues = [["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(120)] for letters in ("abcde", "uvwéx")]
    rows = []
    for i in range(n):
        tongue = tongues[i % 2]
        rows.append((i, " ".join(tongue[min(int(rng.expovariate(0.05)), 119)] + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(20, 160)))))
    rare = [(1000 + k, " ".join(f"Only{k}x{j}" for j in range(9))) for k in range(8)]
    return rows + rare + [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "One"), (2003, "one"), (2003, "one"), (None, "no id é"), (None, None), (2004, "long " * 400_000), (2005, "w" * 3_000_000)]


@pytest.mark.parametrize("sizes", [(24 << 20, 64 << 20), (3000, 2000)])
def test_counts_and_base(spark, monkeypatch, sizes):
    from cytolake.llm import maxent_lm as m

    monkeypatch.setattr(m, "BLOCK_BYTES", sizes[0])
    monkeypatch.setattr(m, "PART_BYTES", sizes[1])
    rows = corpus() if sizes[0] > 10_000 else corpus()[:-2]
    df = m.language_scores(frame(spark, rows))
    assert df.columns == COLUMNS
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 6))
    got = sorted((tuple(r) for r in df.collect()), key=key)
    for a, b in zip(got, sorted(base(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6 * b[2]) and math.isfinite(a[6]) and a[6] < 0


def test_it_learns_from_the_words_before(spark):
    from cytolake.llm import maxent_lm as m

    got = [r for r in m.language_scores(frame(spark, corpus(800)[:800]), passes=4, batch=32).collect()]
    gain = {h: np.mean([(r.score - r.base_score) / r.n_tokens for r in got if r.held_out == h]) for h in (True, False)}
    assert gain[False] > 0.2 and gain[True] > 0.05  # the language alone is worth 0.3, once the first words tell it; so few texts are fitted closely


def test_shares_sum_to_one(spark):
    from cytolake.llm import maxent_lm as m

    rng = np.random.default_rng(1)
    size = rng.integers(0, 50, m.TAILS)
    model = m.Model(np.array([5], np.uint64), np.array([0]), 9, 9, size, np.minimum(size, rng.integers(0, 50, m.TAILS)), *[None] * 6)
    for k in range(m.TAILS):
        slot = np.full(4, m.WORDS + k)
        counts = rng.multinomial(size[k], [0.5, 0.3, 0.2]) if size[k] else np.zeros(3, int)
        total = model.shares(slot, np.append(counts[counts > 0], [0] * (1 + (counts == 0).sum())))[: (counts > 0).sum() + 1].sum()
        assert total == pytest.approx(1.0) or size[k] == 0 and total == 0.5
    assert model.shares(np.array([3]), np.array([7]))[0] == 1.0


def test_features_follow_the_history():
    from cytolake.llm import maxent_lm as m

    rng = np.random.default_rng(2)
    rows = np.sort(rng.integers(0, 40, 500))
    hashes = rng.integers(0, 6, 500)
    whole = m.features(rows, hashes)
    seen = {}
    for t in range(500):
        past = [int(hashes[t - k]) if t >= k and rows[t - k] == rows[t] else -1 for k in (1, 2, 3)]
        for f, key in enumerate((past[:1], past[:2], past[1:2], past[2:])):
            assert seen.setdefault((f, tuple(key)), whole[f, t]) == whole[f, t]
    assert len(set(seen.values())) == len(seen)
    old, m.BATCH = m.BATCH, 16
    try:
        assert np.array_equal(np.concatenate([f for _, _, f in m.chunks(rows, hashes, 1)], axis=1), whole)
    finally:
        m.BATCH = old


def test_descent_is_the_gradient():
    from cytolake.llm import maxent_lm as m

    rng = np.random.default_rng(3)
    rows, error = rng.integers(0, 9, 200).astype(np.int32), rng.normal(size=(200, 5)).astype(np.float32)
    weights, uses = rng.normal(size=(9, 5)).astype(np.float32), np.arange(9) * 1000.0
    want = weights.copy()
    for r in range(9):
        want[r] -= m.RATE * error[rows == r].sum(axis=0) / max(math.sqrt(1000 * r + (rows == r).sum()), (rows == r).sum())
    m._descend(weights, uses, rows, error)
    assert weights == pytest.approx(np.clip(want, -m.BOUND, m.BOUND), abs=1e-4) and list(uses) == [1000 * r + (rows == r).sum() for r in range(9)]


def test_every_token_moves_the_rows_of_all_features(spark):
    """One batch of descent, against a loop over its tokens."""
    from cytolake.llm import maxent_lm as m

    texts = ["a b a c d a b", "b a b a", "a"]
    zeros = lambda: (np.zeros((1 << m.CLASS_BITS, m.CLASSES), np.float32), np.zeros((1 << m.SLOT_BITS, m.SLOTS), np.float32), np.zeros(1 << m.CLASS_BITS), np.zeros(1 << m.SLOT_BITS))
    biases = np.zeros(m.CLASSES, np.float32), np.zeros((m.CLASSES, m.SLOTS), np.float32)
    model = m.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), 15, 5, np.zeros(m.TAILS, np.int64), np.zeros(m.TAILS, np.int64), *biases, *zeros())
    data, parts = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    rows, hashes, tails = m.token_stream(data, parts)
    feature, slot = m.features(rows, model.slots(hashes, tails)), model.slots(hashes, tails)
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean").coalesce(1)
    got = m.fit(spark, docs, model, rounds=1)
    for k, index, _, target in got.softmaxes(feature, slot):
        weights, uses = ((got.class_rows, got.class_uses), (got.slot_rows, got.slot_uses))[k]
        step, count = np.zeros_like(weights), np.zeros_like(uses)
        for t in range(len(rows)):
            for f in range(m.FEATURES):
                step[index[f, t]] += 1 / weights.shape[1] - (np.arange(weights.shape[1]) == target[t])
                count[index[f, t]] += 1
        assert list(uses) == list(count) and count.sum() == m.FEATURES * len(rows)
        assert weights == pytest.approx(-m.RATE * step / np.maximum(count, 1)[:, None], abs=1e-5)


def test_distinct_hashes():
    from cytolake.llm import maxent_lm as m

    hashes = np.random.default_rng(6).integers(0, 1 << 64, 300, np.uint64)[np.random.default_rng(7).integers(0, 300, 2000)]
    distinct, place = m._distinct_of(hashes)
    assert list(distinct) == sorted(set(hashes.tolist())) and np.array_equal(distinct[place], hashes)
    assert [len(x) for x in m._distinct_of(hashes[:0])] == [0, 0]


def test_held_out_texts_are_not_learned(spark):
    from cytolake.llm import maxent_lm as m

    rows = corpus()[:60]
    changed = [(i, "other words here" if out(i) else t) for i, t in rows]
    one = lambda r: {x.doc_id: x for x in m.language_scores(spark.createDataFrame([(i, t, None, None, None) for i, t in r], DOCS).repartition(1)).collect()}
    a, b = one(rows), one(changed)
    for i, _ in rows:
        if not out(i):
            assert a[i].base_score == pytest.approx(b[i].base_score) and a[i].score == pytest.approx(b[i].score, abs=1e-3)


def test_small_tables(spark):
    from cytolake.llm import maxent_lm as m

    assert m.language_scores(spark.createDataFrame([], DOCS)).count() == 0
    lone = next(i for i in range(99) if out(i))
    got = m.language_scores(spark.createDataFrame([(lone, "a b", None, None, None)], DOCS)).first()
    assert tuple(got)[:6] == (lone, True, 3, 0, 0, 0.0) and math.isfinite(got.score)
