"""Merkle manifest of a dataset: a tree of digests for each language, a tree over their roots, and a proof for every row.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests go in as hex text. A leaf is H of doc_id, source,
lang, n_chars and text, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and the value. Leaves of a language
ascend by doc_id; every 8 consecutive nodes become their H until one is left, the subroot, and subroots in order of
language become the root alike.

Levels are built by grouping eight rows each, bottom-up, and stored as parent-linked nodes: a node row holds the digests
of its children, its parent and its place there. A recursive query then ascends from every leaf: it folds the leaf's
digest into each node's children and appends these. What lies above a run of eight leaves is the same for all of them,
so the recursion appends siblings once for each run and folds once for each leaf. Rows that climb carry a digest or a
run's proof, never a text; no task holds more than eight nodes of a group, or a range of a language's doc_ids.

Rows that repeat are leaves of their own; those that share a doc_id follow the order of their digests. A null doc_id
comes first in its language and is never tampered with; a null language is a language of its own, the first. A single
leaf is its subroot, a single language's subroot the root, and without siblings the proof is the digest of nothing.
Empty tables give no rows. Empty texts differ from null ones (``0:`` and ``-``), long texts are hashed where they are
read. Other columns than the five are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.order import before, ranged
from .common import cut, spent

#: Children of a node, and characters of a digest.
FAN, WIDE = 8, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of subroots, beside those of the languages, which count from 0.
TOP = -1


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    def framed(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*[framed(c) for c in fields]))


def lower_ascii(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def tampered_rows(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): the digests of every row, and of the row with its text's A-Z in lower case where it is tampered with."""
    own = [F.col(c) for c in FIELDS]
    changed = [*own[:-1], lower_ascii(own[-1])]
    leaf = leaf_digest(*own)
    return docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(tampered_rows(F.col("doc_id")), leaf_digest(*changed)).otherwise(leaf).alias("tampered"))


def _levels(level: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The written levels above ``level`` (tree, n, idx, hash), and the node that is left of each tree.

    A level has (tree, level, idx, kids, hash, n): n nodes of a tree are on it. Trees end at different heights.
    """
    most = level.agg(F.max("n")).first()[0] or 1  # one number: nodes of the largest tree
    found: list[DataFrame] = []
    left = level.filter("n = 1").select("tree", "hash")
    while most > 1:
        most = -(-most // FAN)
        kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]), "")  # FAN at most
        runs = level.filter("n > 1").groupBy("tree", F.ceil(F.col("n") / FAN).alias("_n"), F.floor(F.col("idx") / FAN).alias("_run")).agg(kids.alias("kids"))
        up = cut(runs.select("tree", F.lit(len(found) + 1).alias("level"), F.col("_run").alias("idx"), "kids", digest(F.col("kids")).alias("hash"), F.col("_n").alias("n")), "merkle")
        found.append(up)
        level = up.select("tree", "n", "idx", "hash")
        left = left.unionByName(level.filter("n = 1").select("tree", "hash"))
    return found, left


def _numbered(rows: DataFrame, by: Sequence[str], value: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the position from 0 within ``by``, in two steps: ranges of ``value``, a number that rises with ``order``, then within a range."""
    spread = ranged(rows.withColumn("_v", value.cast("double")), by, "_v")
    return before(spread, by, order, F.lit(1), name).withColumn(name, F.col(name).cast("long")).drop("_v", "_range")


def _link(tree: Column, level: Column, idx: Column) -> Column:
    """Where a node hangs: its parent, and its place among the parent's children."""
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), F.floor(idx / FAN).cast("long").alias("idx"), (idx % FAN).cast("int").alias("slot"))


@dataclass
class Manifest:
    """``leaves`` (tree, n, idx, doc_id, leaf, tampered, up), ``nodes`` (tree, level, idx, kids, up), ``subroots`` (tree, hash), ``root`` (root)."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: DataFrame


def build(docs: DataFrame) -> Manifest:
    """All levels of all trees, written, each node linked to its parent."""
    rows = cut(leaves(docs), "leaves")
    bytes_ = F.conv(F.rpad(F.hex(F.substring(F.col("lang").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = cut(_numbered(langs, [], F.coalesce(bytes_, F.lit(-1.0)), [F.col("lang").asc_nulls_first()], "tree"), "merkle")
    n_trees = langs.count()
    own = langs.select(F.col("lang").alias("_lang"), "tree", "n")
    placed = _numbered(rows, ["lang"], F.col("doc_id"), [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tampered")], "idx")
    # a tree's last node hangs in the tree of subroots, where there are several
    crown = F.when(F.lit(n_trees > 1), _link(F.lit(TOP), F.lit(1), F.col("tree")))
    inside = lambda level: F.when(F.col("n") > 1, _link(F.col("tree"), level, F.col("idx")))
    placed = placed.join(own, placed["lang"].eqNullSafe(own["_lang"])).withColumn("up", inside(F.lit(1)).otherwise(crown))
    placed = cut(placed.select("tree", "n", "idx", "doc_id", "leaf", "tampered", "up"), "leaves")
    low, ends = _levels(placed.select("tree", "n", "idx", F.col("leaf").alias("hash")))
    subroots = cut(ends, "merkle")
    high, top = _levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("idx"), "hash"))
    parent = inside(F.col("level") + 1).when(F.col("tree") != TOP, crown)
    nodes = placed.filter(F.lit(False)).select("tree", F.lit(1).alias("level"), "idx", F.lit("").alias("kids"), "up")
    for level in (*low, *high):
        nodes = nodes.unionByName(level.select("tree", "level", "idx", "kids", parent.alias("up")))
    nodes, root = cut(nodes, "merkle"), cut(top.select(F.col("hash").alias("root")), "merkle")
    spent(rows, langs, *low, *high)
    return Manifest(placed, nodes, subroots, root)


_NEXT = "FROM climb c JOIN {nodes} n ON n.tree = c.up.tree AND n.level = c.up.level AND n.idx = c.up.idx"
_BEFORE, _AFTER = f"left(n.kids, c.up.slot * {WIDE})", f"substr(n.kids, c.up.slot * {WIDE} + {WIDE + 1})"

#: From every leaf to the root: the digest that comes of the tampered row and the siblings as they were.
FOLD = f"""
WITH RECURSIVE climb(tree, idx, up, fold) AS (
  SELECT tree, idx, up, tampered FROM {{leaves}}
  UNION ALL
  SELECT c.tree, c.idx, n.up, sha2(concat({_BEFORE}, c.fold, {_AFTER}), 256) {_NEXT}
) SELECT tree, idx, fold FROM climb WHERE up IS NULL LIMIT ALL
"""

#: From every run of leaves to the root: the siblings on the way, the same for all leaves of the run.
PROOF = f"""
WITH RECURSIVE climb(tree, idx, up, proof) AS (
  SELECT tree, idx, up, '' FROM {{nodes}} WHERE level = 1
  UNION ALL
  SELECT c.tree, c.idx, n.up, concat(c.proof, {_BEFORE}, {_AFTER}) {_NEXT}
) SELECT tree, idx, proof FROM climb WHERE up IS NULL LIMIT ALL
"""


def verified(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified."""
    spark, m = docs.sparkSession, build(docs)
    folds = cut(spark.sql(FOLD, leaves=m.leaves, nodes=m.nodes), "folds")
    proofs = cut(spark.sql(PROOF, nodes=m.nodes), "proofs").toDF("_t", "_r", "proof")
    runs = m.nodes.filter("level = 1").select(F.col("tree").alias("_t"), F.col("idx").alias("_r"), "kids").join(proofs, ["_t", "_r"])
    rows = m.leaves.join(folds, ["tree", "idx"]).join(m.subroots.withColumnRenamed("hash", "subroot"), "tree")
    rows = rows.join(runs, (F.col("up.tree") == F.col("_t")) & (F.col("up.idx") == F.col("_r")), "left").crossJoin(F.broadcast(m.root))  # one row
    at = F.col("up.slot") * WIDE
    siblings = F.concat(F.substr("kids", F.lit(1), at), F.substr("kids", at + WIDE + 1), F.col("proof"))
    return rows.select("doc_id", "leaf", "subroot", "root", digest(F.coalesce(siblings, F.lit(""))).alias("proof_sha256"), F.col("fold").alias("folded_root"), (F.col("fold") == F.col("root")).alias("verified"))
