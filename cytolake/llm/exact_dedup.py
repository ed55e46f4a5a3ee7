"""Exact dedup with Patricia-trie owners.

Texts are compared without white space. They are dealt into partitions by length, in powers of two, and by as many bits of
their content hash as make a partition ``PART_BYTES`` of text in the mean; a partition's full byte strings go into one
compressed radix trie, where texts share what they begin with, and whose terminal nodes hold the best identifier and a
count. Each scan task first does the same for the rows that it reads, so a hot text leaves it once. When a trie holds
more bytes than its limit, the heaviest subtrees go to a temporary file of the task and are finished one after another,
through tries of their own: a lost task begins anew from its shuffled rows.

Null counts as empty; all empty texts are one group. Of equal texts the row with the most code points in the original
text stays, then the smallest doc_id (a null doc_id comes last). Repeated rows count as often as they occur. A trie holds its
limit and one text more at most, however long the text; an empty table gives an empty result, and no column but doc_id
and text counts, whatever its name. Owners come back to their rows by the text's SHA-256: light rows, of which a hot
text's are split by adaptive execution.
"""

from __future__ import annotations

import math
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without_space

#: Bytes of text that a trie holds before it spills subtrees.
TRIE_BYTES = 64 << 20
#: Bytes of text of a partition, in the mean, if all lengths were alike.
PART_BYTES = 32 << 20
_OUT = "_sha binary, _part long, _body binary, _points long, _id long, _n long"


class PatriciaTrie:
    """Compressed radix trie over byte strings. Each terminal holds ``[points, id, count, extra]`` of its string."""

    def __init__(self, limit: int = TRIE_BYTES):
        self.root: dict[int, list] = {}  # first byte -> [edge label, children, terminal or None]
        self.empty: list | None = None
        self.limit, self.held = limit, 0
        self.weight: dict[int, int] = {}  # bytes held below each first byte
        self.files: dict[int, object] = {}
        self.shared, self.spills = 0, 0  # bytes that insertions did not store, as the trie held them; subtrees that went to a file

    @staticmethod
    def better(a: list, b: list) -> list:
        """The owner of two: most code points, then smallest id, a null id last. Counts add up."""
        first = min(a, b, key=lambda t: (-t[0], t[1] is None, t[1] or 0))
        return [first[0], first[1], a[2] + b[2], a[3]]

    def insert(self, key: bytes, terminal: list) -> None:
        if not key:
            self.empty = terminal if self.empty is None else self.better(self.empty, terminal)
            return
        if key[0] in self.files:
            pickle.dump((key, terminal), self.files[key[0]])
            return
        level, at = self.root, 0
        while True:
            node = level.get(key[at])
            if node is None:
                level[key[at]] = [key[at:], {}, terminal]
                self.shared += at
                self.grow(key[0], len(key) - at)
                return
            label = node[0]
            end = at + len(label)
            if key[at:end] != label:
                same = self.common(label, key[at:end])
                level[key[at]] = fork = [label[:same], {label[same]: node}, None]
                node[0] = label[same:]
                node, end = fork, at + same
            if end == len(key):
                self.shared += end
                node[2] = terminal if node[2] is None else self.better(node[2], terminal)
                return
            level, at = node[1], end

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            if a[:mid] == b[:mid]:
                low = mid
            else:
                high = mid - 1
        return low

    def grow(self, first: int, by: int) -> None:
        self.held += by
        self.weight[first] = self.weight.get(first, 0) + by
        while self.held > self.limit and self.weight:
            self.spill(max(self.weight, key=self.weight.get))

    def spill(self, first: int) -> None:
        file = tempfile.TemporaryFile()
        for entry in self._walk(self.root.pop(first), b""):
            pickle.dump(entry, file)
        self.held -= self.weight.pop(first)
        self.files[first] = file
        self.spills += 1

    @staticmethod
    def _read(file) -> Iterator[tuple[bytes, list]]:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return

    @staticmethod
    def _walk(node: list, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(node, prefix)]
        while stack:
            (label, children, terminal), before = stack.pop()
            key = before + label
            if terminal is not None:
                yield key, terminal
            stack += [(child, key) for child in children.values()]

    def items(self) -> Iterator[tuple[bytes, list]]:
        """Every string with its terminal; spilled subtrees last, each through a trie of its own below what its strings share."""
        if self.empty is not None:
            yield b"", self.empty
        for node in self.root.values():
            yield from self._walk(node, b"")
        self.root, self.empty = {}, None
        for file in self.files.values():
            head = None  # what all strings of the file begin with: the next trie forks right below it
            for key, _ in self._read(file):
                head = key if head is None else head[: self.common(head, key)]
            below = PatriciaTrie(self.limit)
            for n, (key, terminal) in enumerate(self._read(file)):
                below.insert(key[len(head) :], terminal)
                self.shared += len(head) if n else 0
            file.close()
            for key, terminal in below.items():
                yield head + key, terminal
            self.spills, self.shared = self.spills + below.spills, self.shared + below.shared
        self.files = {}


def _emit(items, keep: bool) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[] for _ in range(6)]
    size = 0
    names = ("_sha", "_part", "_body", "_points", "_id", "_n")
    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    for key, (points, ident, count, (sha, part)) in items:
        for c, v in zip(cols, (sha, part, key if keep else None, points, ident, count), strict=True):
            c.append(v)
        size += len(key)
        if size > 8 << 20 or len(cols[0]) >= 10_000:
            yield batch()
            cols, size = [[] for _ in range(6)], 0
    if cols[0]:
        yield batch()


def _entries(b: pa.RecordBatch) -> Iterator[tuple[bytes, list]]:
    rest = [b.column(c).to_pylist() for c in ("_points", "_id", "_n", "_sha", "_part")]
    for key, points, ident, n, sha, part in zip(b.column("_body"), *rest, strict=True):
        yield key.as_py(), [points, ident, n, (sha, part)]


def _combine(limit: int):
    """Per scan task: one row for each text that the rows read so far hold; handed on whenever the trie is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(limit=1 << 62)
        for b in batches:
            for key, terminal in _entries(b):
                trie.insert(key, terminal)
                if trie.held > limit:  # a batch may hold many long texts
                    yield from _emit(trie.items(), True)
                    trie = PatriciaTrie(limit=1 << 62)
        yield from _emit(trie.items(), True)

    return run


def _own(limit: int, tell: Callable[[PatriciaTrie], None] = lambda _: None):
    """Per reduce task, whose rows come sorted by partition: one trie for each. ``tell`` is given every trie that is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def owners():
            trie, part = PatriciaTrie(limit), None
            for b in batches:
                for key, terminal in _entries(b):
                    if terminal[3][1] != part:
                        yield from trie.items()
                        tell(trie)
                        trie, part = PatriciaTrie(limit), terminal[3][1]
                    trie.insert(key, terminal)
            yield from trie.items()
            tell(trie)

        yield from _emit(owners(), False)

    return run


def exact_dedup(docs: DataFrame, limit: int = TRIE_BYTES, part_bytes: int = PART_BYTES, tell: Callable[[PatriciaTrie], None] = lambda _: None) -> DataFrame:
    """One row per document: keep_id, group_size, kept, and the SHA-256 of the text without white space."""
    text = F.coalesce(F.col("text"), F.lit(""))
    body = without_space(text)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / part_bytes))))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.length(text).cast("long").alias("_points"), body.alias("_text"))
    rows = rows.select("_id", "_points", F.encode("_text", "UTF-8").alias("_body"))
    light = rows.select("_id", "_points", F.unhex(F.sha2("_body", 256)).alias("_sha"))
    length = F.length(F.bin(F.octet_length("_body").cast("long"))).cast("long")
    part = length * (1 << bits) + (F.shiftrightunsigned(F.xxhash64("_body"), 64 - bits) if bits else F.lit(0))
    full = rows.select(F.unhex(F.sha2("_body", 256)).alias("_sha"), part.cast("long").alias("_part"), "_body", "_points", "_id", F.lit(1).cast("long").alias("_n"))
    combined = full.mapInArrow(_combine(limit), _OUT)
    owned = combined.repartition("_part").sortWithinPartitions("_part").mapInArrow(_own(limit, tell), _OUT)
    owners = owned.select("_sha", F.col("_id").alias("keep_id"), F.col("_n").alias("group_size"))
    return light.join(owners, "_sha").select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", F.coalesce(F.col("_id") == F.col("keep_id"), F.col("_id").isNull() & F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")
    )
