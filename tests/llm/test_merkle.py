"""The manifest against a tree that is built and climbed in plain Python."""

import hashlib
import random
import zlib

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def climb(levels, k):
    """Siblings of node k of the lowest level, level by level, as (before, after)."""
    out = []
    for level in levels[:-1]:
        a = k // 8 * 8
        out.append((level[a:k], level[k + 1 : a + 8]))
        k //= 8
    return out


def tree(level):
    levels = [level]
    while len(level) > 1:
        level = [h(*level[k : k + 8]) for k in range(0, len(level), 8)]
        levels.append(level)
    return levels


def expected(rows):
    langs = {}
    for i, text, lang, source, n in rows:
        own = leaf(i, source, lang, n, text)
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        langs.setdefault(lang, []).append((i is not None, i or 0, own, leaf(i, source, lang, n, low) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else own))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in names:
        langs[x].sort()
        trees[x] = tree([r[2] for r in langs[x]])
    top = tree([trees[x][-1][0] for x in names])
    out = []
    for t, x in enumerate(names):
        for k, (there, i, own, tampered) in enumerate(langs[x]):
            path = climb(trees[x], k) + climb(top, t)
            fold = tampered
            for a, b in path:
                fold = h(*a, fold, *b)
            out.append((i if there else None, own, trees[x][-1][0], top[-1][0], h(*[s for a, b in path for s in a + b]), fold, fold == top[-1][0]))
    return out


def corpus(n, langs, seed=1):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("aBcé \n") for _ in range(rng.randint(0, 30))), rng.choice(langs), rng.choice(["w", None]), rng.choice([None, 3])) for i in rng.sample(range(10**6), n)]
    return rows + [(7, None, langs[0], None, None), (7, None, langs[0], None, None), (7, "X", langs[0], None, None), (None, "Y", langs[-1], "s", 1), (8, "", "", "", 0), (-3, "Z" * 200_000, langs[0], "s", 1)]


@pytest.mark.parametrize(("n", "langs"), [(600, ["en", "en", "en", "fr", None, "é"]), (40, ["en"]), (90, [f"l{k}" for k in range(70)])])
def test_manifest(spark, n, langs):
    from cytolake.llm import merkle_manifest as m

    rows = corpus(n, langs)
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS tree", "2 AS idx", "3 AS up", "4 AS kids").repartition(5)
    got = m.verified(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(expected(rows), key=key)


@pytest.mark.parametrize("rows", [[], [(1, "One", "en", "s", 3)], [(i, "Aa", "en", "s", 2) for i in range(3)], [(1, "A", "en", None, None), (2, "B", None, None, None)]])
def test_small_manifests(spark, rows):
    from cytolake.llm import merkle_manifest as m

    assert sorted(tuple(r) for r in m.verified(spark.createDataFrame(rows, DOCS)).collect()) == sorted(expected(rows))
