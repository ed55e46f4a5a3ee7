"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of all characters over its present share. A uniform number
in [0, 1), seeded by a hash of doc_id, is put through the inverse Poisson distribution with that mean; the document is
written out as often as the result says, so the expected share of each source is its target and the same rows always
give the same counts. At last all copies are dealt and sorted by a hash of (seed, doc_id, copy): a global shuffle.

Without explicit weights the target of a source is in proportion to its characters to the power ``alpha``. A null
source is a source of its own, with the weight given for None; null texts have no characters, and a source without any
has rate 1. Repeated rows (same doc_id) get the same count, so counts have no ties to break; a null doc_id hashes as
empty. Documents travel as one struct, so no column of theirs can clash; long texts are moved whole, and empty tables
give none.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

ALPHA, SEED = 0.7, "mix-1"
#: Numbers in the tables of all sources up to which these are broadcast (8 MB); beyond, they are joined by a shuffle.
BROADCAST_NUMBERS = 1_000_000
#: Copies of a document that one array lists.
_BLOCK = 4096


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _cumulative(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Poisson cumulative probabilities of each rate, from ``low`` to where they round to 1.

    Both ends are 12 standard deviations from the mean, so a table grows with the root of the rate only. What is left out
    below has a probability under 1e-30, which no sum of doubles shows.
    """
    for b in batches:
        tables, lows = [], []
        for rate in b["rate"]:
            low = max(0, int(rate - 12 * rate**0.5))
            k = np.arange(low, int(rate + 12 * rate**0.5 + 30))
            terms = np.log(np.arange(low + 1, low + len(k)))
            factorial = lgamma(low + 1) + np.concatenate([[0.0], np.cumsum(terms)])
            tables.append(np.cumsum(np.exp(k * np.log(rate) - rate - factorial)) if rate > 0 else np.ones(1))
            lows.append(low)
        yield b.assign(cdf=tables, low=lows)


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """Per source: its characters, its target share and its rate; statistics over all documents."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("chars").cast("double"), F.lit(alpha)))
    else:
        named = {k: v for k, v in weights.items() if k is not None}
        given = F.create_map(*[F.lit(x) for kv in named.items() for x in kv]) if named else F.create_map().cast("map<string,double>")
        own = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(F.try_element_at(given, F.coalesce("source", F.lit(""))).cast("double"))
        sizes = sizes.withColumn("w", F.coalesce(own, F.lit(0.0)))
    whole = sizes.agg(F.sum("chars").alias("all_chars"), F.sum("w").alias("all_w"))
    share = F.col("w") / F.when(F.col("all_w") > 0, F.col("all_w"))
    rate = F.when(F.col("chars") > 0, F.coalesce(share, F.lit(0.0)) * F.col("all_chars") / F.col("chars")).otherwise(F.lit(1.0))
    return sizes.crossJoin(F.broadcast(whole)).select("source", "chars", F.coalesce(share, F.lit(0.0)).alias("target"), rate.alias("rate"))  # whole: one row


def replicated(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """``_row`` (the document), its rate, count and copy number (from 0), globally shuffled."""
    per = rates(docs, weights, alpha).mapInPandas(_cumulative, "source string, chars long, target double, rate double, cdf array<double>, low long")
    per = cut(per.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("_s"), F.col("rate").alias("_rate"), F.col("cdf").alias("_cdf"), F.col("low").alias("_low")), "rates")
    few = (per.agg(F.sum(F.size("_cdf"))).first()[0] or 0) <= BROADCAST_NUMBERS
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("_s"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), uniform(seed, F.col("doc_id")).alias("_u")
    )
    rows = rows.join(F.broadcast(per) if few else per, "_s")
    rows = rows.withColumn("_n", F.col("_low") + F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))).filter("_n > 0")
    blocks = rows.select("_row", "_rate", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _BLOCK))).alias("_b"))
    copies = blocks.select("_row", "_rate", "_n", F.explode(F.sequence(F.col("_b") * _BLOCK, F.least(F.col("_n"), (F.col("_b") + 1) * _BLOCK) - 1)).alias("_copy"))
    copies = copies.withColumn("_at", F.xxhash64(F.lit(seed), "_row.doc_id", "_copy"))
    return copies.repartition("_at").sortWithinPartitions("_at")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mixture, with the columns of ``docs``."""
    return replicated(docs, **how).select("_row.*")


def mixing_report(docs: DataFrame, **how) -> DataFrame:
    """One row per copy: doc_id, source, copy, the document's count, its source's rate, and the text."""
    rows = replicated(docs.select("doc_id", "source", "text"), **how)
    return rows.select("_row.doc_id", "_row.source", F.col("_copy").cast("int").alias("copy"), F.col("_n").cast("int").alias("n_copies"), F.round("_rate", 6).alias("rate"), "_row.text")
