"""Quality rules as a bitmask ledger: each rule is evaluated once, and its verdict is one bit of a long.

``ledger`` measures every text and stores the measurements with the failure bits of all rules. A policy is a version
and a mask; applying one is ``failed & mask = 0``, so a new policy needs no second pass over the texts, and
``ablation`` counts from the bits alone what each rule rejects and what only it rejects.

Native: DataFrame functions only. Nothing is shuffled; the work of a document stays in its row.
Nulls and empty texts have no words and fail ``few_words``. Rows are judged one by one and whole, so repeated rows
agree, there are no ties, and a long text costs its own row only; an empty table gives an empty ledger. A column that
has the ledger's name is replaced; other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, count_of, let, split_words

#: Order fixes the bit of each rule; add at the end only.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "4 * n_symbols > n_words",
    "long_words": "word_chars > 40 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines",
    "shouting": "n_upper * 100 > 40 * greatest(word_chars, 1)",
}


@dataclass(frozen=True)
class Policy:
    """A named set of rules; a document is kept if it fails none of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
FULL = Policy("full-1", tuple(RULES))


def repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the text, the first find included."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
            return F.transform(F.filter(s, lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["i"])

        return let(ordered, lambda s: F.size(F.array_distinct(F.flatten(F.transform(starts(s), lambda p: F.array(p, p + 1, p + 2))))))

    def of(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        windows = F.slice(hashes, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return let(words, of).cast("long")


def measurements(text: Column) -> Column:
    """All measurements of a text, as one struct; the text is split once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^")))
    return let(
        F.struct(split_words(text).alias("w"), lines.alias("l")),
        lambda v: F.struct(
            F.size(v["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(v["w"], "")).cast("long").alias("word_chars"),
            count_of(text, r"[#*$%&|<>]").alias("n_symbols"),
            (F.size(v["l"]) - F.size(F.array_distinct(v["l"]))).cast("long").alias("n_dup_lines"),
            repeat_words(v["w"]).alias("n_repeat_words"),
            F.size(v["l"]).cast("long").alias("n_lines"),
            count_of(text, "[A-Z]").alias("n_upper"),
        ),
    )


def ledger(docs: DataFrame, text: str = "text", out: str = "ledger") -> DataFrame:
    """``docs`` with the struct ``out``: the measurements, and ``failed``, the bits of the rules that the text fails."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), measurements(F.col(f"`{text}`")).alias("_m"))
    flat = rows.select("_row", "_m.*")
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    names = [c for c in flat.columns if c != "_row"]
    entry = F.struct(*names, failed.alias("failed")).alias(out)
    return flat.select("_row", entry).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() != out.lower()], out)


def passes(policy: Policy, failed: Column) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(entries: DataFrame, policy: Policy, failed: str = "ledger.failed", count: str | None = None) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that the policy would keep without it; ``count``, if given, is how many an entry stands for."""
    hit = F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long"))
    per_hit = entries.groupBy(hit.alias("hit")).agg((F.sum(count) if count else F.count(F.lit(1))).alias("n"))  # 2^rules rows at most
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in policy.rules]))
    return (
        per_hit.select("hit", "n", rules.alias("r"))
        .groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("hit").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("hit") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def quality_rules(docs: DataFrame, policy: Policy = FULL) -> DataFrame:
    """One row per document: measurements, failure bits, the base verdict and the policy's verdict."""
    e = ledger(docs.select("doc_id", "text"))
    return e.select(
        "doc_id",
        *[f"ledger.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~passes(BASE, F.col("ledger.failed"))).alias("base_failed"),
        (passes(BASE, F.col("ledger.failed")) & passes(policy, F.col("ledger.failed"))).alias("kept"),
        F.col("ledger.failed").alias("failed_bits"),
        F.lit(policy.version).alias("policy"),
        "ledger.n_lines",
        "ledger.n_upper",
    )


def ablation_report(docs: DataFrame, policies: tuple[Policy, ...] = (BASE, FULL)) -> DataFrame:
    """Per policy and rule: documents that fail it, and those that it alone rejects; the texts are measured once."""
    e = ledger(docs.select("text")).select(F.col("ledger.failed").alias("failed")).groupBy("failed").agg(F.count(F.lit(1)).alias("n"))  # 2^rules rows at most
    out = None
    for policy in policies:
        one = ablation(e, policy, "failed", "n")
        out = one if out is None else out.unionByName(one)
    return out


def keep_passing(docs: DataFrame, policy: Policy = FULL) -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("text"))
    kept = ledger(rows, out="_ledger").filter(passes(Policy("both", tuple(dict.fromkeys((*BASE.rules, *policy.rules)))), F.col("_ledger.failed")))
    return kept.select("_row.*")
