"""Near-duplicate documents by b-bit MinHash.

Every text becomes the set of its distinct word shingles, and that set ``rows * bands`` minima. Full minima make the
band keys that generate candidates; of each minimum only the low ``bits`` bits are kept and packed into longs, and a
candidate's similarity is estimated from the bit counts of their differences, corrected for chance collisions. What
passes (well below the threshold, so that no link is lost to the estimate) is confirmed on the full sets of both texts.

With 56 bands of 6 rows a pair at similarity 0.8 shares no band with probability 4e-8. Equal sets are collapsed first.
In each of a few rounds every bucket names one member by hash, each other member takes the likeliest of those that its
buckets name, these pairs are confirmed, and components are found; a bucket whose members are all in one component
needs no further pairs. At last all pairs that are left across components of a bucket are confirmed too, but for those
that a bound on their difference rules out: each document has a bitmap of the parities of its hashed shingles, and bits
in which two bitmaps differ are shingles that only one of both has. Two sets at the threshold differ in a known share
of their sizes at most, so no link is ever ruled out, while documents that share a template or a passage and no more
never leave the join: what it gives are links, and the few pairs that miss one by a hair.

Empty and null texts have no shingles and are linked with nothing; shorter texts than a shingle are one shingle. Long
texts are read whole; the bitmaps of the longest are folded, which rules out less and loses nothing. Rows that share a
doc_id are one vertex (their links are joined). Rows with a null doc_id take no part and are kept. Of rows with equal
sets the smallest doc_id stands for all; an empty table gives an empty result, and no column but doc_id and text counts,
whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import cut, spent
from .components import merged

ROWS, BANDS, BITS, MARGIN, ROUNDS = 6, 56, 2, 0.15, 2
_SKETCH = "_id long, n_shingles long, _s1 long, _s2 long, _bands array<long>, _sig array<long>"
_CHUNK = 512
#: Bits of a bitmap for each shingle, and longs of a bitmap at most.
_BITS_EACH, _LONGS = 8, 64


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row, without space and case (A-Z) differences."""
    data, offsets = tokens.text_bytes(column)
    for a, b in tokens.slices(offsets):
        part = offsets[a : b + 1]
        row, word, _, _ = tokens.words(data[part[0] : part[-1]], part - part[0])
        counts = np.bincount(row, minlength=b - a)
        at, sh, _ = tokens.shingles(row, word, width)
        edges = np.searchsorted(at, np.arange(b - a + 1))
        ends = np.concatenate([[0], np.cumsum(counts)])
        for r in range(b - a):
            if counts[r] >= width:
                yield np.unique(sh[edges[r] : edges[r + 1]])
            elif counts[r]:
                whole = np.uint64(counts[r])  # the whole sequence as one shingle
                for w in word[ends[r] : ends[r + 1]]:
                    whole = tokens.mix(np.array([whole * np.uint64(31) + w], np.uint64))[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = tokens.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def minima(values: np.ndarray, factor: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The minimum of every permutation over a set; the working matrix stays small however long the set."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), _CHUNK):
        h = low[k : k + _CHUNK, None] * factor
        h += offset
        np.minimum(best, h.min(axis=0), out=best)
    return best


def pack(best: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of the mixed minima, ``64 // bits`` to a long."""
    low = tokens.mix(best.astype(np.uint64)) & np.uint64((1 << bits) - 1)
    per = 64 // bits
    padded = np.zeros(-(-len(low) // per) * per, np.uint64)
    padded[: len(low)] = low
    return (padded.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(bits))).sum(axis=1, dtype=np.uint64)


def _sketch(width: int, rows: int, bands: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, offset = _permutations(rows * bands)
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for b in batches:
            n, one, two, keys, sigs = [], [], [], [], []
            for s in _sets(b.column("text"), width):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    one.append(tokens.mix(s).sum(dtype=np.uint64) if len(s) else np.uint64(0))
                    two.append(np.bitwise_xor.reduce(tokens.mix(s + np.uint64(0x5851F42D4C957F2D))) if len(s) else np.uint64(0))
                if not len(s):
                    keys.append(None)
                    sigs.append(None)
                    continue
                best = minima(s, factor, offset)
                key = salt.copy()
                for column in best.reshape(bands, rows).T:
                    key = tokens.mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
                keys.append(key.view(np.int64))
                sigs.append(pack(best, bits).view(np.int64))
            ids = b.column("_id")
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), longs(one), longs(two), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))],
                names=["_id", "n_shingles", "_s1", "_s2", "_bands", "_sig"],
            )

    return run


def parities(values: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set, in a power of two of longs; half as many longs are the two halves' exclusive or."""
    longs = min(_LONGS, 1 << max(0, (-(-_BITS_EACH * len(values) // 64) - 1).bit_length()))
    odd = np.bincount((tokens.mix(values) & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _bitmaps(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [parities(s) for s in _sets(b.column("text"), width)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(maps, pa.list_(pa.int64()))], names=["_id", "_map"])

    return run


def apart(x: Column, y: Column) -> Column:
    """Shingles that two sets do not share, at least: the bits in which their bitmaps differ, in the width of the narrower."""
    narrow = F.least(F.size(x), F.size(y))

    def folded(z: Column) -> Column:
        halves = F.zip_with(F.slice(z, 1, narrow), F.slice(z, narrow + 1, narrow), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(z) == narrow, z).otherwise(halves)

    # sets whose sizes are within a factor of two have bitmaps within one of two
    bits = F.aggregate(F.zip_with(folded(x), folded(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    return F.when(F.greatest(F.size(x), F.size(y)) <= 2 * narrow, bits).otherwise(F.lit(0))


def estimate(a: Column, b: Column, n: int, bits: int) -> Column:
    """Similarity from packed signatures: lanes that agree, less those expected to agree by chance."""
    lanes = sum(1 << (k * bits) for k in range(64 // bits))
    mask = F.lit(lanes - (1 << 64) if lanes >= 1 << 63 else lanes).cast("long")

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        any_ = d
        for k in range(1, bits):
            any_ = any_.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(any_.bitwiseAND(mask))

    other = F.aggregate(F.zip_with(a, b, differing), F.lit(0).cast("int"), lambda s, x: s + x)
    chance = 1.0 / (1 << bits)
    return ((F.lit(n) - other) / F.lit(float(n)) - chance) / (1 - chance)


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(_sets(b.column("_ta"), width), _sets(b.column("_tb"), width), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both) and both > 0
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, bits: int = BITS, margin: float = MARGIN, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: n_shingles, component_id (the smallest doc_id reachable) and kept."""
    n = rows * bands
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    sketched = cut(source.mapInArrow(_sketch(width, rows, bands, bits), _SKETCH))
    classes = cut(sketched.filter("n_shingles > 0 AND _id IS NOT NULL").groupBy("_s1", "_s2").agg(F.min("_id").alias("rep")))
    own = classes.withColumnRenamed("rep", "_id")
    reps = sketched.filter("n_shingles > 0").join(own, ["_id", "_s1", "_s2"], "left_semi")
    some = sketched.select("_id", "n_shingles", "_s1", "_s2").filter("n_shingles > 0")
    classed = cut(some.join(classes, ["_s1", "_s2"], "left").select("_id", "n_shingles", F.col("rep").alias("_rep")))
    keyed = reps.select("_id", F.explode("_bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("_id").alias("_near"), F.max("_id").alias("_far")).filter("_near < _far").select("key")
    buckets = cut(keyed.join(shared, "key").select("key", F.col("_id").alias("id")))
    needed = buckets.select(F.col("id").alias("_id")).distinct()
    held = cut(source.join(needed, "_id", "left_semi"))
    sigs = cut(reps.select("_id", "_sig", "n_shingles").join(needed, "_id", "left_semi"))

    def scored(pairs: DataFrame) -> DataFrame:
        x = sigs.select(F.col("_id").alias("a"), F.col("_sig").alias("_x"))
        y = sigs.select(F.col("_id").alias("b"), F.col("_sig").alias("_y"))
        return pairs.join(x, "a").join(y, "b").withColumn("est", estimate(F.col("_x"), F.col("_y"), n, bits)).drop("_x", "_y")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = held.select(F.col("_id").alias("a"), F.col("text").alias("_ta"))
        y = held.select(F.col("_id").alias("b"), F.col("text").alias("_tb"))
        return cut(pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(_confirm(width, percent), "a long, b long"))

    # an id that repeats with other texts ties its classes together
    ties = classed.filter("_rep <> _id").select(F.col("_id").alias("a"), F.col("_rep").alias("b")).join(own.select(F.col("_id").alias("a")), "a", "left_semi")
    labels = merged(needed.unionByName(ties.select(F.col("a").alias("_id"))).unionByName(ties.select(F.col("b").alias("_id"))).distinct().select(F.col("_id").alias("id"), F.col("_id").alias("comp")), ties)
    least = percent / 100 - margin
    tested = None

    def open_buckets() -> DataFrame:
        """Members, with components, of buckets that still hold two components or more."""
        named = buckets.join(labels, "id")
        split = named.groupBy("key").agg(F.min("comp").alias("_c1"), F.max("comp").alias("_c2")).filter("_c1 < _c2").select("key")
        return cut(named.join(split, "key"))

    def fresh(pairs: DataFrame) -> DataFrame:
        return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")

    named = open_buckets()
    for turn in range(rounds):
        center = named.groupBy("key").agg(F.min_by(F.struct("id", "comp"), F.xxhash64(F.lit(turn), "id")).alias("_c"))
        stars = named.join(center, "key").filter("comp <> _c.comp").select("id", F.greatest("id", "_c.id").alias("a"), F.least("id", "_c.id").alias("b")).distinct()
        best = scored(fresh(stars)).filter(F.col("est") >= least).groupBy("id").agg(F.max_by(F.struct("a", "b"), F.struct("est", "a", "b")).alias("_p"))
        pairs = cut(best.select("_p.*").distinct())
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        before, links = (labels, named), confirmed(pairs)
        labels = merged(labels, links)
        named = open_buckets()
        spent(*before, links)
    # What is left across components of a bucket: all of it. Sizes, the estimate and the bitmaps are part of the join.
    inside = named.select(F.col("id").alias("_id")).distinct()
    maps = held.join(inside, "_id", "left_semi").mapInArrow(_bitmaps(width), "_id long, _map array<long>")
    sizes = sigs.join(maps, "_id").select(F.col("_id").alias("id"), "_sig", F.col("n_shingles").alias("n"), "_map")
    full = cut(named.join(cut(sizes), "id"))
    x = full.select(F.col("key").alias("_k"), F.col("id").alias("a"), F.col("comp").alias("_ca"), F.col("_sig").alias("_x"), F.col("n").alias("_na"), F.col("_map").alias("_ma"))
    y = full.select("key", F.col("id").alias("b"), F.col("comp").alias("_cb"), F.col("_sig").alias("_y"), F.col("n").alias("_nb"), F.col("_map").alias("_mb"))
    near = (F.col("_k") == F.col("key")) & (F.col("_ca") < F.col("_cb")) & (100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb"))
    close = (100 + percent) * apart(F.col("_ma"), F.col("_mb")) <= (100 - percent) * (F.col("_na") + F.col("_nb"))
    rest = x.join(y, near & (estimate(F.col("_x"), F.col("_y"), n, bits) >= least) & close).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest = cut(fresh(rest))
    if not rest.isEmpty():
        labels = merged(labels, confirmed(rest))
    spent(buckets, held, sigs, named, full, rest)  # what follows reads classes, sketches and labels
    vertex = classed.join(labels.select(F.col("id").alias("_rep"), "comp"), "_rep", "left").select("_id", "n_shingles", "_rep", "comp")
    empty = sketched.filter("n_shingles = 0").select("_id", "n_shingles", F.lit(None).cast("long").alias("_rep"), F.lit(None).cast("long").alias("comp"))
    vertex = vertex.unionByName(empty)  # these join nothing
    done = F.when(F.col("_id").isNotNull(), F.coalesce("comp", "_rep", "_id"))
    return vertex.select(F.col("_id").alias("doc_id"), "n_shingles", done.alias("component_id"), F.coalesce(F.col("_id") == done, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id, with its own columns.

    Rows that repeat a kept doc_id stay where their texts differ; of those that repeat its text too one stays, the same
    one in every run. Rows with a null doc_id all stay.
    """
    kept = near_duplicates(docs, **how).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    some = rows.join(kept, "_id", "left_semi").withColumn("_sha", F.sha2(F.encode(text, "UTF-8"), 256))
    one = some.groupBy("_id", "_sha").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return one.select("_row.*").unionByName(docs.filter("doc_id IS NULL"))
