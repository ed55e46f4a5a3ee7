"""Line dedup by content-defined chunks of lines, and by the lines that repeat beside them.

The lines of a text are hashed; a rolling (cyclic polynomial) hash over the last ``window`` line hashes ends a chunk
wherever it is 0 modulo ``divisor``, so boundaries depend on nearby lines only and survive shifts. A chunk of two lines or
more that the corpus holds in an earlier place too is removed; places go by doc_id, then by line (``chunk_dedup``).

A repeated run of lines sticks out of its chunks at both ends, and a short one may have no chunk to itself.
``line_dedup``, which the query and the pipeline use, therefore goes on from the chunks to whole runs: of the lines that
no removed chunk holds, every pair that follow each other is looked up in the same way. The first place of a pair is
never inside a removed chunk, so what chunks have settled need not meet again, and every repeated run of two lines or
more goes whole, whatever surrounds it. The first place of any line is never removed, and within a document a pair that
overlaps its own first place is no repeat. Empty lines are lines.

Native: DataFrame functions only. Light (hash, document, place) rows meet; then bytes are compared, of every chunk and
pair that shares its hash. If two texts meet under one hash, all is hashed anew with another seed. Nulls stay null, a
text that loses all its lines becomes empty, lines shared singly stay. Rows that share a doc_id count as one document,
rows without one are returned unchanged; an empty table stays empty. Long texts are one row each, with as many marks as
lines at most. Documents travel as one struct, so no column of theirs can clash.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

WINDOW, DIVISOR, LEAST_LINES = 2, 3, 2


def _hash(seed: int, *cols: Column) -> Column:
    return F.xxhash64(*cols, F.lit(seed)) if seed else F.xxhash64(*cols)


def _rotated(h: Column, by: int) -> Column:
    return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _ends(h: Column, window: int, divisor: int) -> Column:
    """Index of the last line of every chunk, from the lines' hashes."""

    def rolled(i: Column) -> Column:
        acc = F.get(h, i)
        for k in range(1, window):
            acc = acc.bitwiseXOR(_rotated(F.coalesce(F.get(h, i - k), F.lit(0).cast("long")), k))
        return acc

    last = F.size(h) - 1
    return F.filter(F.sequence(F.lit(0), last), lambda i: (F.pmod(rolled(i), F.lit(divisor)) == 0) | (i == last))


def spans(h: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """First line and number of lines (_k, _n) of every chunk."""
    return let(
        _ends(h, window, divisor),
        lambda e: F.transform(e, lambda x, i: let(F.coalesce(F.get(e, i - 1), F.lit(-1)) + 1, lambda first: F.struct(first.alias("_k"), (x - first + 1).alias("_n")))),
    )


def chunks(text: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Array of arrays: the lines of a text, chunk by chunk."""
    return let(_lines(text), lambda x: F.transform(spans(F.transform(x, lambda y: F.xxhash64(y)), window, divisor), lambda s: F.slice(x, s["_k"] + 1, s["_n"])))


def _placed(h: Column, parts: Column, seed: int) -> Column:
    """Parts of a text (_k, _n) with their hashes."""
    return F.transform(parts, lambda s: F.struct(s["_k"].alias("_k"), s["_n"].alias("_n"), _hash(seed, F.slice(h, s["_k"] + 1, s["_n"])).alias("_h")))


def _marked(places: DataFrame) -> DataFrame:
    """Of places (_id, _k, _n, _h) those whose hash has several; ``_later``: whether it has an earlier one that this does not overlap."""
    owners = places.groupBy("_h").agg(F.min(F.struct("_id", "_k")).alias("_o"), F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    owners = cut(owners.select("_h", F.col("_o._id").alias("_oid"), F.col("_o._k").alias("_ok")), "owners")  # written, so that a join can split a hot hash
    later = (F.col("_id") > F.col("_oid")) | (F.col("_k") >= F.col("_ok") + F.col("_n"))
    return places.join(owners, "_h").select("_id", "_k", "_n", "_h", later.alias("_later"))


def _marks(docs: DataFrame, window: int, divisor: int, runs: bool, seed: int) -> DataFrame:
    """Per document: its repeated chunks, and pairs of lines outside removed chunks, wherever they stand."""
    hashes = F.transform(_lines(F.col("text")), lambda x: _hash(seed, x))
    light = cut(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), hashes.alias("_hs")), "hashes")  # 8 bytes a line
    h = F.col("_hs")
    own = light.select("_id", F.explode(_placed(h, F.filter(spans(h, window, divisor), lambda s: s["_n"] >= LEAST_LINES), seed)).alias("_p")).select("_id", "_p.*")
    marked = cut(_marked(own), "chunks")
    if runs:
        gone = marked.filter("_later").groupBy("_id").agg(F.collect_set(F.struct("_k", "_n", "_h")).alias("_gone"))  # a document's own chunks at most
        held = light.join(gone, "_id", "left")
        pairs = F.transform(F.slice(h, 1, F.size(h) - 1), lambda _, i: F.struct(i.alias("_k"), F.lit(2).alias("_n")))
        inside = lambda p, g: (p["_k"] >= g["_k"]) & (p["_k"] + 1 < g["_k"] + g["_n"]) & (_hash(seed, F.slice(h, g["_k"] + 1, g["_n"])) == g["_h"])
        rest = F.when(F.col("_gone").isNull(), pairs).otherwise(F.filter(pairs, lambda p: ~F.exists("_gone", lambda g: inside(p, g))))
        beside = held.select("_id", F.explode(_placed(h, rest, seed)).alias("_p")).select("_id", "_p.*")
        marked = marked.unionByName(_marked(beside))
    return marked.groupBy("_id").agg(F.collect_set(F.struct("_k", "_n", "_h", "_later")).alias("_marks"))


def _removed(docs: DataFrame, window: int, divisor: int, runs: bool) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    for seed in count():
        held = cut(rows.join(_marks(docs, window, divisor, runs, seed), "_id", "left").select("_row", "_marks"), "lines")
        hashed = lambda x, m: _hash(seed, F.transform(F.slice(x, m["_k"] + 1, m["_n"]), lambda y: _hash(seed, y)))  # noqa: B023, E731
        # rows that share a doc_id may differ in text: a mark counts where the row has that part at that place
        own = lambda x: F.filter("_marks", lambda m: (m["_k"] + m["_n"] <= F.size(x)) & (hashed(x, m) == m["_h"]))  # noqa: B023, E731
        part = lambda x: F.transform(own(x), lambda m: F.struct(m["_h"].alias("_h"), F.concat_ws("\n", F.slice(x, m["_k"] + 1, m["_n"])).alias("_text")))  # noqa: B023, E731
        texts = held.filter("_marks IS NOT NULL").select(F.explode(let(_lines(F.col("_row.text")), part)).alias("_p")).select("_p.*")
        if texts.groupBy("_h", "_text").agg(F.lit(1).alias("_one")).groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").isEmpty():
            break
    left = let(
        _lines(F.col("_row.text")),
        lambda x: let(
            F.array_distinct(F.flatten(F.transform(F.filter(own(x), lambda m: m["_later"]), lambda m: F.sequence(m["_k"], m["_k"] + m["_n"] - 1)))),
            lambda gone: F.struct(
                F.concat_ws("\n", F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda k: F.get(x, k))).alias("text"),
                F.size(x).cast("long").alias("n_lines"),
                F.size(gone).cast("long").alias("n_lines_removed"),
                F.size(F.array_except(gone, F.transform(gone, lambda k: k + 1))).cast("long").alias("n_chunks_removed"),
            ),
        ),
    )
    none = F.lit(0).cast("long")
    whole = F.struct(F.col("_row.text").alias("text"), F.size(_lines(F.col("_row.text"))).cast("long").alias("n_lines"), none.alias("n_lines_removed"), none.alias("n_chunks_removed"))
    done = held.select("_row", F.when(F.col("_marks").isNull(), whole).otherwise(left).alias("_d"))
    text = F.when(F.col("_d.n_lines_removed") > 0, F.col("_d.text")).otherwise(F.col("_row.text"))
    fresh = {"text": text, "n_chars": F.length(text).cast("long")}
    return done.select(*[fresh.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns], F.struct("_d.n_lines", "_d.n_lines_removed", "_d.n_chunks_removed").alias("_dedup"))


def chunk_dedup(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``; ``n_chars`` follows. Adds struct ``_dedup``: lines before, lines and runs of lines removed."""
    return _removed(docs, window, divisor, runs=False)


def line_dedup(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """``docs`` with repeated runs of lines taken out of ``text``, by chunks first; otherwise as ``chunk_dedup``."""
    return _removed(docs, window, divisor, runs=True)


def deduped(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated runs of lines taken out of their texts, and no column more."""
    return line_dedup(docs).drop("_dedup")


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts, and the text that is left."""
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", "_dedup.*", "text")
