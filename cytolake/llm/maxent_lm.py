"""A hashed maximum-entropy language model with a class-factored softmax, beside a unigram base.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z in lower case, and one end. Documents whose
crc32(doc_id as text) mod 5 is 1 are held out; the model and all counts come from all others.

A token is drawn in three steps: its class, its slot in the class, and itself in the slot. The ``WORDS`` most frequent
words of training have slots of their own; all other words share slots by a hash of their last letters. Class and slot
are softmaxes over hashed features of the words before: bigram, trigram and two skips, one row of weights each. Within a
shared slot words have their share of training counts, less what Good and Turing give to one unknown word there (tokens
of words seen once). So probabilities of the known words and one unknown word of each shared slot sum to 1.

Counts cover the corpus: blocks of documents give their distinct words, parts of the hashed vocabulary add them up and
send every block the counts of its own words, in order of hash. Nothing that grows with the vocabulary meets in one place.
Training is distributed: in each of ``ROUNDS`` rounds all tasks go on from the same weights, descend over their own
documents in batches of tokens, every document in one round and every token with the rows of all its features, and the
weights are averaged by how often each row was used.
The model has a fixed size, whatever the corpus.

Words go by 64-bit hashes. Null texts count as empty and are one end; a null doc_id is never held out; rows that repeat
are scored and counted each. Texts are worked on a slice of a block at a time, a long text alone. Without training
tokens every score has only the unknown word's share. Empty tables give no rows; no column but doc_id and text is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import cut

#: Classes, and slots of a class; words with a slot of their own fill the first classes.
CLASSES, SLOTS = 32, 32
WORDS = 640
TAILS = CLASSES * SLOTS - WORDS
#: Rows of weights of the class and of the slot softmax, as powers of two, and the number of features.
CLASS_BITS, SLOT_BITS, FEATURES = 14, 15, 4
ROUNDS, RATE, BATCH, BOUND = 2, 0.6, 2048, 8.0
#: Bytes of text of a block, and of a part of the vocabulary.
BLOCK_BYTES, PART_BYTES = 24 << 20, 64 << 20
_CHUNK = 512
_END = np.uint64(1)
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


# ---- tokens ---------------------------------------------------------------------------------------------------------


def token_stream(data: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and shared slot of every token of a slice of texts; each row ends in its end."""
    n = len(part) - 1
    row, word, first, end = tokens.words(data, part)
    at = np.arange(len(word)) + row
    size = np.bincount(row, minlength=n)
    ends = np.cumsum(size) + np.arange(n)
    rows, hashes, tails = np.repeat(np.arange(n), size + 1), np.empty(len(word) + n, np.uint64), np.zeros(len(word) + n, np.uint16)
    hashes[at], hashes[ends] = word, _END
    letters = np.zeros(len(word), np.uint32)
    for back in (1, 2, 3):
        letters <<= np.uint32(8)
        if len(data):
            letters += np.take(tokens._LOWER, np.take(data, np.maximum(end - back, 0))) * (end - back >= first)
    tails[at] = tokens.mix(letters + np.uint64(1)) % np.uint64(TAILS)
    return rows, hashes, tails


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows of a text column with their bytes."""
    data, offsets = tokens.text_bytes(column)
    for a, b in tokens.slices(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def features(rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """(feature, token): 64-bit hashes of the slots of the word before, of the two before, and of the second and third before alone."""
    fresh = np.ones(len(rows), bool)
    fresh[1:] = rows[1:] != rows[:-1]
    before = [slots.astype(np.uint64) + np.uint64(1)]
    for _ in range(3):
        prior = np.zeros_like(before[0])  # nothing is before a text
        prior[1:] = before[-1][:-1]
        prior[fresh] = 0
        before.append(prior)
    _, one, two, three = before
    kind = np.uint64(1 << 40)
    return np.stack([one * _ODD[0], ((one << np.uint64(20)) + two + kind) * _ODD[0], (two + kind * np.uint64(2)) * _ODD[0], (three + kind * np.uint64(3)) * _ODD[0]])


def chunks(rows: np.ndarray, slots: np.ndarray, most: int = 32) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of ``most`` batches of tokens with their features; three tokens ahead of a range are its history."""
    for a in range(0, len(rows), most * BATCH):
        lead, b = min(a, 3), min(len(rows), a + most * BATCH)
        yield a, b, features(rows[a - lead : b], slots[a - lead : b])[:, lead:]


# ---- vocabulary -----------------------------------------------------------------------------------------------------


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash; parts are ranges, so that they keep the order of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _distinct_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and each hash's place among them: only the distinct are sorted."""
    coded = pa.array(hashes).dictionary_encode()
    distinct = coded.dictionary.to_numpy()
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return distinct[order], rank[coded.indices.to_numpy()]


def _block_words(table: pa.Table) -> tuple[np.ndarray, ...]:
    """A block's tokens (row, place among the distinct), and the distinct hashes with their shared slots, in order of hash."""
    rows, hashes, tails = [], [], []
    for a, _, data, part in slices(table.column("text")):
        r, h, t = token_stream(data, part)
        rows.append(r + a)
        hashes.append(h)
        tails.append(t)
    rows, hashes, tails = np.concatenate(rows), np.concatenate(hashes), np.concatenate(tails)
    distinct, place = _distinct_of(hashes)
    own = np.empty(len(distinct), np.uint16)
    own[place] = tails  # a word has one
    return rows, place, distinct, own


def _distinct(parts: int):
    def run(table: pa.Table) -> pa.Table:
        rows, place, distinct, tails = _block_words(table)
        trained = ~table.column("held_out").to_numpy()
        n = np.bincount(place[trained[rows]], minlength=len(distinct)).astype(np.uint32)
        own, starts = np.unique(_part(distinct, parts), return_index=True)
        cuts = [*starts, len(distinct)]
        piece = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        return pa.table({"block": pa.array(np.full(len(own), table.column("block")[0].as_py(), np.int64)), "part": own.astype(np.int64), "hash": piece(distinct), "n": piece(n), "tail": piece(tails)})

    return run


def _added(table: pa.Table) -> pa.Table:
    """Of one part: each block's words with their counts over the corpus (kind 0), the shared slots' sums (1), the most frequent words (2)."""
    take = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
    hashes, n, tails = take("hash", np.uint64), take("n", np.uint32), take("tail", np.uint16)
    distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    count = np.bincount(place, weights=n, minlength=len(distinct)).astype(np.int64)
    tails = tails[first].astype(np.int64)
    sizes = np.cumsum([0] + [len(x) // 8 for x in table.column("hash").to_pylist()])
    sent = [count[place[a:b]].tobytes() for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    sums = [np.bincount(tails, weights=w, minlength=TAILS).astype(np.int64) for w in (count, count == 1, count > 0)]
    top = np.lexsort((distinct, -count))[:WORDS]
    top = top[count[top] > 0]
    blocks = table.num_rows
    kinds = np.repeat([0, 1, 2], [blocks, TAILS, len(top)])
    none = np.zeros(blocks, np.int64)
    return pa.table({
        "kind": kinds.astype(np.int32), "block": np.concatenate([table.column("block").to_numpy(), np.zeros(TAILS + len(top), np.int64)]), "part": np.full(len(kinds), table.column("part")[0].as_py()),
        "counts": pa.array(sent + [None] * (TAILS + len(top)), pa.binary()), "key": np.concatenate([none, np.arange(TAILS), distinct[top].view(np.int64)]),
        "x": np.concatenate([none, sums[0], count[top]]), "y": np.concatenate([none, sums[1], tails[top]]), "z": np.concatenate([none, sums[2], none[:0], np.zeros(len(top), np.int64)]),
    })


# ---- the model ------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Slots of the frequent words, sums over the shared slots, and the weights."""

    hashes: np.ndarray
    slot_of: np.ndarray
    tokens: int
    distinct: int
    size: np.ndarray
    once: np.ndarray
    class_bias: np.ndarray
    slot_bias: np.ndarray
    class_rows: np.ndarray
    slot_rows: np.ndarray
    class_uses: np.ndarray
    slot_uses: np.ndarray

    def slots(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        return np.where(known, self.slot_of[at] if len(self.hashes) else 0, WORDS + tails.astype(np.int64))

    def softmaxes(self, feature: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of both softmaxes: which it is, the rows of weights of every token's features, biases and targets."""
        classes, inner = slot // SLOTS, slot % SLOTS
        yield 0, _rows_of(feature), self.class_bias, classes
        yield 1, _rows_of(feature, classes), np.take(self.slot_bias, classes, axis=0), inner

    def shares(self, slot: np.ndarray, count: np.ndarray) -> np.ndarray:
        """What a word with a training count has of its slot; without one, what the slot has for an unknown word."""
        k = np.where(slot >= WORDS, slot - WORDS, 0)
        unknown = (self.once[k] + 0.5) / (self.size[k] + 1)
        return np.where(slot < WORDS, 1.0, np.where(count > 0, (1 - unknown) * count / np.maximum(self.size[k], 1), unknown))


def _rows_of(feature: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    if classes is None:
        return (feature * _ODD[2] >> np.uint64(64 - CLASS_BITS)).astype(np.int32)
    return ((feature ^ (classes.astype(np.uint64) + np.uint64(1)) * _ODD[3]) * _ODD[1] >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def _powers(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """exp of the logits, (token, outcome); weights are bounded, so nothing overflows."""
    out = np.take(weights, rows[0], axis=0)
    for r in rows[1:]:
        out += np.take(weights, r, axis=0)
    out += bias
    return np.exp(out, out=out)


def _descend(weights: np.ndarray, uses: np.ndarray, rows: np.ndarray, error: np.ndarray) -> None:
    """One step along the rows of all features, (feature, token) or (token): by the sum of errors over the root of the row's uses so far, at most by the mean error."""
    flat = rows.ravel()
    order = np.argsort(flat.astype(np.uint16), kind="stable")  # 16 bits sort by digits
    ranked = flat[order]
    at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    own = ranked[at].astype(np.int64)
    fresh = np.diff(np.append(at, len(flat)))
    used = uses[own] + fresh
    uses[own] = used
    token = np.tile(np.arange(len(error)), len(flat) // len(error))[order]
    step = np.take(error, token[at], axis=0)
    twice = np.flatnonzero(fresh > 1)
    step[twice] += np.take(error, token[at[twice] + 1], axis=0)
    many = fresh > 2  # only these have sums to work out
    if many.any():
        part = np.take(error, token[np.repeat(many, fresh)], axis=0)
        sums = np.add.reduceat(part if part.shape[1] % 2 else part.view(np.complex64), np.cumsum(fresh[many]) - fresh[many], axis=0)  # two outcomes at a time
        step[many] = sums.view(np.float32)
    step *= (RATE / np.maximum(np.sqrt(used), fresh)).astype(np.float32)[:, None]
    moved = np.take(weights, own, axis=0)
    moved -= step
    weights[own] = np.clip(moved, -BOUND, BOUND, out=moved)


def _trained(shared, batch: int):
    """Descent over a task's documents; every token of a batch moves the rows of all its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights, uses = (m.class_rows.copy(), m.slot_rows.copy()), (m.class_uses.copy(), m.slot_uses.copy())
        for b in batches:
            for _, _, data, part in slices(b.column("text")):
                rows, hashes, tails = token_stream(data, part)
                slot = m.slots(hashes, tails)
                for at, end, feature in chunks(rows, slot):
                    own = slot[at:end]
                    for x in range(0, end - at, batch):
                        for k, index, bias, target in m.softmaxes(feature[:, x : x + batch], own[x : x + batch]):
                            error = _powers(weights[k], index, bias)
                            error /= (error @ np.ones(error.shape[1], np.float32))[:, None]
                            error[np.arange(len(target)), target] -= 1
                            _descend(weights[k], uses[k], index, error)
        salt = TaskContext.get().partitionId() // 32  # the first sum takes 32 tasks, the second what is left
        for k, before in enumerate((m.class_uses, m.slot_uses)):
            here = uses[k] - before
            own = np.column_stack([weights[k], uses[k]]) * here[:, None]
            for chunk in np.unique(np.flatnonzero(here) // _CHUNK):
                part = slice(chunk * _CHUNK, (chunk + 1) * _CHUNK)
                yield pa.RecordBatch.from_pydict({"table": pa.array([k], pa.int32()), "chunk": pa.array([int(chunk)], pa.int32()), "salt": pa.array([salt], pa.int32()), "n": pa.array([here[part].tobytes()], pa.binary()), "w": pa.array([own[part].astype(np.float32).tobytes()], pa.binary())})

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = lambda c, kind: np.sum([np.frombuffer(x, kind) for x in table.column(c).to_pylist()], axis=0).astype(kind).tobytes()
    first = table.slice(0, 1).select(["table", "chunk"]).to_pydict()
    return pa.table({"table": pa.array(first["table"], pa.int32()), "chunk": pa.array(first["chunk"], pa.int32()), "salt": pa.array([0], pa.int32()), "n": pa.array([total("n", np.float64)], pa.binary()), "w": pa.array([total("w", np.float32)], pa.binary())})


_WEIGHTS = "table int, chunk int, salt int, n binary, w binary"


def fit(spark: SparkSession, docs: DataFrame, model: Model, rounds: int = ROUNDS, passes: int = 1, batch: int = BATCH) -> Model:
    """Rounds of descent from the same weights in all tasks, and of averages; ``rounds`` make a pass over all documents.

    The weights, of fixed size, pass through the driver.
    """
    for turn in range(rounds * passes):
        shared = spark.sparkContext.broadcast(model)  # its size is fixed: rows x outcomes
        mine = docs.filter(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == turn % rounds)).select("text")
        parts = mine.mapInArrow(_trained(shared, batch), _WEIGHTS)
        sums = parts.groupBy("table", "chunk", "salt").applyInArrow(_summed, _WEIGHTS).groupBy("table", "chunk").applyInArrow(_summed, _WEIGHTS).toArrow()
        own = ((model.class_rows.copy(), model.class_uses.copy()), (model.slot_rows.copy(), model.slot_uses.copy()))
        for r in sums.to_pylist():
            n = np.frombuffer(r["n"], np.float64)
            w = np.frombuffer(r["w"], np.float32).reshape(len(n), -1)
            there = r["chunk"] * _CHUNK + np.flatnonzero(n)
            mean = w[n > 0] / n[n > 0, None]
            weights, uses = own[r["table"]]
            weights[there], uses[there] = mean[:, :-1], mean[:, -1]
        (model.class_rows, model.class_uses), (model.slot_rows, model.slot_uses) = own
        shared.unpersist()
    return model


def _vocabulary(added: DataFrame) -> Model:
    """The model before training: slots and sums from the counts, biases from the slots' shares. ``WORDS`` + ``TAILS`` rows reach the driver."""
    sums = {r["key"]: r for r in added.filter("kind = 1").groupBy("key").agg(*[F.sum(c).alias(c) for c in "xyz"]).collect()}
    size, once, distinct = (np.array([sums[k][c] if k in sums else 0 for k in range(TAILS)], np.int64) for c in "xyz")
    top = added.filter("kind = 2").orderBy(F.col("x").desc(), "key").limit(WORDS).select("key", "x", "y").collect()
    n_tokens, n_distinct = int(size.sum()), int(distinct.sum())
    counts = np.zeros(CLASSES * SLOTS)
    for k, r in enumerate(top):  # words with a slot of their own leave the shared one
        counts[k] = r["x"]
        size[r["y"]] -= r["x"]
        once[r["y"]] -= r["x"] == 1
    counts[WORDS:] = size
    counts = counts.reshape(CLASSES, SLOTS) + 0.5
    hashes = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    share = lambda x, axis: np.log(x / x.sum(axis=axis, keepdims=True)).astype(np.float32)
    return Model(
        hashes[order], order.astype(np.int64), n_tokens, n_distinct, size, once, share(counts.sum(axis=1), 0), share(counts, 1),
        np.zeros((1 << CLASS_BITS, CLASSES), np.float32), np.zeros((1 << SLOT_BITS, SLOTS), np.float32),
        np.zeros(1 << CLASS_BITS), np.zeros(1 << SLOT_BITS),
    )


def _scored(shared):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        m = shared.value
        rows, place, distinct, tails = _block_words(docs)
        order = np.argsort(counts.column("part").to_numpy())
        payload = counts.column("counts").to_pylist()
        count = np.concatenate([np.frombuffer(payload[k], np.int64) for k in order])
        slot = m.slots(distinct, tails)
        # of each distinct word
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.distinct + 1)))
        inside = np.log10(m.shares(slot, count))
        n = docs.num_rows
        total = lambda x: np.bincount(rows, weights=x, minlength=n)
        chance = np.empty(len(rows))
        every = slot[place]
        for a, b, feature in chunks(rows, every):
            own = every[a:b]
            for x in range(0, b - a, BATCH):
                share = 1.0
                for k, index, bias, target in m.softmaxes(feature[:, x : x + BATCH], own[x : x + BATCH]):
                    p = _powers((m.class_rows, m.slot_rows)[k], index, bias)
                    share = share * (p[np.arange(len(target)), target] / (p @ np.ones(p.shape[1], np.float32))).astype(np.float64)
                chance[a + x : a + x + len(target)] = share
        score = total(np.log10(np.maximum(chance, 1e-300)) + inside[place])
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": np.bincount(rows, minlength=n), "n_known": total((count > 0)[place].astype(float)).astype(np.int64),
            "train_tokens": np.full(n, m.tokens), "base_score": total(base[place]), "score": score,
        })

    return run


def language_scores(docs: DataFrame, rounds: int = ROUNDS, passes: int = 1, batch: int = BATCH) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    A pass over all documents suffices for millions of tokens; small corpora take more passes, or smaller batches.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text) + 16)).first()[0] or 0
    blocks, parts = (max(1, math.ceil(size / x)) for x in (BLOCK_BYTES, PART_BYTES))
    own = cut(docs.select("doc_id", text.alias("text"), held_out(F.col("doc_id")).alias("held_out"), F.floor(F.rand(11) * blocks).alias("block")), "blocks")
    words = own.groupBy("block").applyInArrow(_distinct(parts), "block long, part long, hash binary, n binary, tail binary")
    added = cut(words.groupBy("part").applyInArrow(_added, "kind int, block long, part long, counts binary, key long, x long, y long, z long"), "counts")
    model = fit(spark, own, _vocabulary(added), rounds, passes, batch)
    shared = spark.sparkContext.broadcast(model)  # its size is fixed
    kind = dict(docs.dtypes)["doc_id"]
    counts = added.filter("kind = 0").select("block", "part", "counts")
    return own.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_scored(shared), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
