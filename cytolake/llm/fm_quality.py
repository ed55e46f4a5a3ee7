"""Document quality by a factorisation machine.

Inputs are hashed words (their share of the text), structure statistics (symbols, capitals, digits, punctuation, lines,
repetition, as one feature per bin) and the length; labels, language, source and doc_id are never inputs. A score is
w0 + sum w x + 1/2 sum_f ((sum v x)^2 - sum v^2 x^2): all pairwise interactions in linear time. It is fitted by
AdaGrad on ``sample`` labelled rows at most (in hash order of doc_id), and scoring is one pass without a shuffle.

Null and empty texts score from the bins alone. Long texts are read whole, a slice of the batch at a time. Labels that
are null are left out; a document with several labels counts with each of them, and a doc_id with several rows counts
with each row, up to ``sample`` rows in all. Rows that repeat get equal scores. Without any label, and so with empty
tables, all scores are the prior 0.5. No column but doc_id, text and the label counts, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens

BUCKETS, FACTORS, EPOCHS, RATE, DECAY = 1 << 14, 8, 12, 0.1, 1e-5
#: Labelled rows that a model is fitted on, at most.
SAMPLE = 6000
_BINS = 12
_CLASSES = (b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".,;:!?", b"!", b"|", b"\n", bytes(range(128, 192)))
_STATS = len(_CLASSES) + 4
SIZE = BUCKETS + _STATS * _BINS


@dataclass
class Model:
    bias: float
    w: np.ndarray
    v: np.ndarray


def _bin(x: np.ndarray) -> np.ndarray:
    """Bins of shares in [0, 1], finer towards 0."""
    return np.clip(np.ceil(_BINS - 1 + np.log2(np.maximum(x, 1e-9))), 0, _BINS - 1).astype(np.int64)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of the column: its rows, and row, index and value of every feature, rows in order."""
    data, offsets = tokens.text_bytes(column)
    lookup = np.zeros((len(_CLASSES), 256), np.int64)
    for k, chars in enumerate(_CLASSES):
        lookup[k, list(chars)] = 1
    for a, b in tokens.slices(offsets):
        part = offsets[a : b + 1] - offsets[a]
        body = data[offsets[a] : offsets[b]]
        n, size = b - a, np.maximum(np.diff(part), 1)
        row, word, first, end = tokens.words(body, part, lower=False)
        n_words = np.bincount(row, minlength=n)
        key = (row.astype(np.int64) * BUCKETS) + (word % np.uint64(BUCKETS)).astype(np.int64)
        key, count = np.unique(key, return_counts=True)
        rows, index = key // BUCKETS, key % BUCKETS
        value = count / np.maximum(n_words[rows], 1)
        most = np.zeros(n)
        np.maximum.at(most, rows, value)
        stats = []
        for table in lookup:
            sums = np.concatenate([[0], np.cumsum(table[body])])
            stats.append((sums[part[1:]] - sums[part[:-1]]) / size)
        lengths = np.bincount(row, weights=end - first, minlength=n) / np.maximum(n_words, 1)
        distinct = np.bincount(rows, minlength=n) / np.maximum(n_words, 1)
        stats += [most, 1 - np.minimum(1, distinct), np.minimum(1, lengths / 64), np.minimum(1, np.log2(1 + n_words) / 20)]
        bins = [BUCKETS + k * _BINS + (_bin(s) if k < _STATS - 2 else np.minimum((s * _BINS).astype(np.int64), _BINS - 1)) for k, s in enumerate(stats)]
        rows = np.concatenate([rows, np.tile(np.arange(n), _STATS)])
        index = np.concatenate([index, *bins])
        value = np.concatenate([np.sqrt(value), np.ones(n * _STATS)])
        order = np.argsort(rows, kind="stable")
        yield n, rows[order], index[order], value[order]


def raw_scores(model: Model, n: int, rows: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic function, and sum v x, of each row; every row has features."""
    starts = np.searchsorted(rows, np.arange(n))
    vx = model.v[index] * value[:, None]
    sums = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
    return model.bias + np.add.reduceat(model.w[index] * value, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def fit(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS, batch: int = 64) -> Model:
    """Log loss by AdaGrad, in batches of shuffled examples (index, value)."""
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, FACTORS)))
    gw, gv, gb = np.full(SIZE, 1e-4), np.full((SIZE, FACTORS), 1e-4), 1e-4
    for _ in range(epochs if len(examples) else 0):
        order = rng.permutation(len(examples))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            index = np.concatenate([examples[i][0] for i in own])
            value = np.concatenate([examples[i][1] for i in own])
            rows = np.repeat(np.arange(len(own)), [len(examples[i][0]) for i in own])
            raw, sums = raw_scores(model, len(own), rows, index, value)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[own]) / len(own)
            scaled = error[rows] * value
            by = np.argsort(index, kind="stable")
            touched, at = np.unique(index[by], return_index=True)
            dw = np.add.reduceat(scaled[by], at) + DECAY * model.w[touched]
            dv = np.add.reduceat((scaled[:, None] * (sums[rows] - model.v[index] * value[:, None]))[by], at, axis=0) + DECAY * model.v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            gb += error.sum() ** 2
            model.w[touched] -= RATE * dw / np.sqrt(gw[touched])
            model.v[touched] -= RATE * dv / np.sqrt(gv[touched])
            model.bias -= RATE * error.sum() / np.sqrt(gb)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        idx, val = [], []
        for n, rows, index, value in features(b.column("text")):
            at = np.searchsorted(rows, np.arange(n + 1))
            for r in range(n):
                idx.append(index[at[r] : at[r + 1]].astype(np.int32))
                val.append(value[at[r] : at[r + 1]].astype(np.float32))
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("y"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["_id", "y", "idx", "val"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from ``sample`` labelled rows outside the held-out fold at most; these alone reach the driver, as features."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id", "y").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id")  # ``sample`` rows at most
    sparse = rows.mapInArrow(_sparse, "_id long, y int, idx array<int>, val array<float>")
    got = sparse.orderBy(F.xxhash64("_id"), "_id", "y", F.xxhash64("idx", "val")).limit(sample).toArrow()  # a doc_id may stand for many rows
    idx, val = got.column("idx").combine_chunks(), got.column("val").combine_chunks()
    cut = idx.offsets.to_numpy()
    i, v = idx.values.to_numpy().astype(np.int64), val.values.to_numpy().astype(np.float64)
    return fit([(i[a:b], v[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], got.column("y").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x (FACTORS + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [np.zeros(0)]
            for n, rows, index, value in features(b.column("text")):
                raw, _ = raw_scores(m, n, rows, index, value)
                got.append(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(np.concatenate(got))], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample=sample))
