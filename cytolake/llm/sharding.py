"""Sharding by balanced label propagation, under the law that shard counts differ by one at most.

Links are given as hubs: documents that share a hub key (here: equal texts) are linked with each other, so no pair is
ever written out. State is the small table of cells (hub, shard, members). It starts with whole hubs dealt one after
another over the shards, so that a hub is cut only where a shard's share ends; each round joins every cell with its
hub's strongest shard that still has room, ranks the moves into a shard by pull, and takes them until the shard's quota
is full, the last one in part. When no such move is left, cells are swapped for as many members that another cell sends
the other way, or for a whole hub of the same size; the rounds end when no move and no swap gains. Unlinked documents
fill what is left, so quotas hold exactly and a hub larger than a shard spreads over as few shards as fit.

Sizes are UTF-8 bytes plus 16; null text counts as empty, and null or empty texts are linked with nothing. Rows are
placed one by one, so repeated rows each get a slot. Rows of one hub are interchangeable: ranges of their ranks are
mapped to shards at the end; where the hashes that order rows tie, their order within a shard is free, their number and
the quotas are not. An empty table gives an empty result; a long text counts by its hash; no column but doc_id and text
counts, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, position, spent

_RANGES = 512
#: Rows that one task numbers, about.
_ROWS = 100_000


def _hash(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def _steps(quota: DataFrame, key: str) -> DataFrame:
    """Shard ranges: each shard's share of the numbers 0.. as [lo, hi)."""
    w = W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, 0)  # a row for each shard
    return quota.withColumn("hi", F.sum(key).over(w)).withColumn("lo", F.col("hi") - F.col(key)).filter("hi > lo").select("shard", "lo", "hi")


def _placed(rows: DataFrame, number: str, steps: DataFrame) -> DataFrame:
    """The shard whose range holds the number: a look-up in one array with a range for each shard."""
    ranges = steps.agg(F.sort_array(F.collect_list(F.struct("hi", "shard"))).alias("_steps"))
    found = F.element_at(F.filter("_steps", lambda s: s["hi"] > F.col(number)), 1)["shard"]
    return rows.crossJoin(F.broadcast(ranges)).withColumn("shard", found).drop("_steps")  # one row, of n_shards numbers


def _dealt(hubs: DataFrame, steps: DataFrame) -> DataFrame:
    """Cells of hubs (hub, members) laid end to end over the shards' ranges. Sums are taken in two steps, so that no task holds all."""
    hubs = hubs.withColumn("_b", F.pmod(_hash("hub"), F.lit(_RANGES)).cast("int"))
    over = W.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    firsts = hubs.groupBy("_b").agg(F.sum("members").alias("_s")).select("_b", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_first"))
    within = W.partitionBy("_b").orderBy(F.col("members").desc(), "hub").rowsBetween(W.unboundedPreceding, -1)
    at = F.col("_first") + F.coalesce(F.sum("members").over(within), F.lit(0))
    placed = hubs.join(F.broadcast(firsts), "_b").select("hub", "members", at.alias("_at"))  # 512 rows at most
    ranges = steps.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard"))).alias("_steps"))
    met = F.filter("_steps", lambda z: (z["hi"] > F.col("_at")) & (z["lo"] < F.col("_at") + F.col("members")))
    cells = placed.crossJoin(F.broadcast(ranges)).select("hub", "members", "_at", F.explode(met).alias("_z"))  # one row, of n_shards ranges
    return cells.select("hub", F.col("_z.shard").alias("shard"), (F.least("_z.hi", F.col("_at") + F.col("members")) - F.greatest("_z.lo", "_at")).alias("members"))


def _swaps(cells: DataFrame) -> DataFrame:
    """Moves (hub, shard, target, take) that leave every shard's load as it is; each gains, or is a whole hub's that makes way."""
    # a cell asks for its hub's largest; never towards a smaller one, so the sum of squares grows
    best = cells.groupBy("hub").agg(F.max(F.struct(F.col("members").alias("m"), F.pmod(_hash("hub", "shard"), F.lit(1 << 20)).alias("h"), F.col("shard").alias("target"))).alias("best"), F.count(F.lit(1)).alias("_n"))
    both = cut(cells.join(best, "hub").select("hub", "shard", "members", F.col("best.target").alias("target"), "_n"))
    asks = position(both.filter("shard <> target"), ["shard", "target"], _hash("hub"), "_p", 16)
    ahead = asks.select("hub", "shard", "target", "members", "_p")
    back = asks.select(F.col("hub").alias("_hub"), F.col("target").alias("shard"), F.col("shard").alias("target"), F.col("members").alias("_m"), "_p")
    crossed = ahead.join(back, ["shard", "target", "_p"]).select("hub", "shard", "target", F.least("members", "_m").alias("take"))
    crossed = cut(crossed)
    if not crossed.isEmpty():
        return crossed
    wanted = position(both.filter("shard <> target").select("hub", "shard", "target", "members"), ["target", "members"], _hash("hub"), "_p", 16)
    sizes = wanted.select(F.col("target").alias("shard"), "members").distinct()
    whole = position(both.filter("_n = 1").select("hub", "shard", "members").join(sizes, ["shard", "members"], "left_semi"), ["shard", "members"], _hash("hub"), "_p", 16)
    met = cut(wanted.join(whole.select(F.col("hub").alias("_hub"), F.col("shard").alias("target"), "members", "_p"), ["target", "members", "_p"]).select("hub", "shard", "target", F.col("members").alias("take"), "_hub"))
    return met.drop("_hub").unionByName(met.select(F.col("_hub").alias("hub"), F.col("target").alias("shard"), F.col("shard").alias("target"), "take"))


def propagate(cells: DataFrame, quota: DataFrame) -> DataFrame:
    """Cells (hub, shard, members) after moves under ``quota`` (shard, quota); the members of a hub never change."""
    cells = cut(cells)
    while True:
        load = cells.groupBy("shard").agg(F.sum("members").alias("load"))
        room = quota.join(load, "shard", "left").select("shard", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("room"))
        open_ = cells.join(F.broadcast(room), "shard")  # a row for each shard
        rank = F.struct((F.col("members") - F.when(F.col("room") > 0, 0).otherwise(F.lit(1 << 40))).alias("m"), F.pmod(_hash("hub", "shard"), F.lit(1 << 20)).alias("h"), F.col("shard").alias("shard"), F.col("room").alias("room"))
        best = open_.groupBy("hub").agg(F.max(rank).alias("best"), F.max("members").alias("most"))
        asks = (
            cells.join(best, "hub").filter("shard <> best.shard AND best.room > 0 AND members <= best.m")
            .select("hub", "shard", "members", F.col("best.shard").alias("target"), F.col("best.room").alias("room"), F.col("best.m").alias("pull"))
            # never towards a smaller cell: the sum of squares grows with every move, so none goes back and forth
        )
        # strong pulls first; within a pull in hash order. The running sum is taken in two steps, so that no task holds a shard.
        asks = asks.withColumn("_b", F.least(F.lit(63), F.floor(F.log2(F.col("pull").cast("double"))).cast("int")) * -8 + F.pmod(_hash("hub"), F.lit(8)).cast("int"))
        sums = asks.groupBy("target", "_b").agg(F.sum("members").alias("s"))
        over = W.partitionBy("target").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        firsts = sums.select("target", "_b", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("first"))
        within = W.partitionBy("target", "_b").orderBy(_hash("hub", "shard"), "hub", "shard").rowsBetween(W.unboundedPreceding, -1)
        asks = asks.join(F.broadcast(firsts), ["target", "_b"])  # shards x 512 rows at most
        taken = F.least("members", F.greatest(F.lit(0), F.col("room") - F.col("first") - F.coalesce(F.sum("members").over(within), F.lit(0))))
        moves = cut(asks.withColumn("take", taken).filter("take > 0").select("hub", "shard", "target", "take"))
        if moves.isEmpty():
            moves = _swaps(cells)
            if moves.isEmpty():
                return cells
        change = moves.select("hub", "shard", (-F.col("take")).alias("members")).unionByName(moves.select("hub", F.col("target").alias("shard"), F.col("take").alias("members")))
        before, cells = cells, cut(cells.unionByName(change).groupBy("hub", "shard").agg(F.sum("members").alias("members")).filter("members > 0"))
        spent(before, moves)


def shard_rows(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """One row per document: size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_x"))
    rows = rows.withColumn("_hub", F.when(F.col("size") > 16, F.xxhash64("_x", "text_crc32", "size"))).drop("_x")
    spark = docs.sparkSession
    counts = cut(rows.groupBy("_hub").agg(F.count(F.lit(1)).alias("_members")).filter("_hub IS NOT NULL AND _members > 1"))  # written, so that the join below can split a hot hub
    named = rows.filter("_hub IS NOT NULL").join(counts, "_hub", "left").withColumn("_hub", F.when(F.col("_members").isNotNull(), F.col("_hub")))
    none = rows.filter("_hub IS NULL").withColumn("_members", F.lit(None).cast("long"))  # null and empty texts have no key to meet on
    rows = cut(named.unionByName(none))
    linked, single = rows.filter("_hub IS NOT NULL"), rows.filter("_hub IS NULL")
    total = rows.count()
    deal = max(_RANGES, total // _ROWS)  # ranges that rows are numbered in: as many as the rows ask for
    quota = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"), (F.lit(total // n_shards) + F.when(F.col("id") < total % n_shards, 1).otherwise(0)).cast("long").alias("quota"))
    quota = quota.coalesce(1)
    # the first deal: whole hubs in order of their hashes, spread evenly over all shards, within every quota
    n_linked = linked.count()
    first = quota.withColumn("share", F.floor(F.col("quota") * n_linked / max(total, 1)).cast("long"))
    rest = n_linked - first.agg(F.sum("share")).first()[0]
    first = first.withColumn("share", F.col("share") + F.when(F.row_number().over(W.partitionBy(F.lit(0)).orderBy((F.col("share") - F.col("quota")), "shard")) <= rest, 1).otherwise(0))
    order = _hash("doc_id", "text_crc32", F.lit("deal"))
    cells = propagate(_dealt(linked.groupBy(F.col("_hub").alias("hub")).agg(F.count(F.lit(1)).alias("members")), _steps(first, "share")), quota)
    # members of a hub, by rank, take its cells in order of shard
    spans = cells.groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("shard", "members"))).alias("_cells"))  # n_shards cells at most
    ends = F.transform("_cells", lambda c, i: F.struct(F.aggregate(F.slice("_cells", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x["members"]).alias("hi"), c["shard"].alias("shard")))
    spans = cut(spans.select(F.col("hub").alias("_hub"), ends.alias("_ends")))
    ranked = position(linked, ["_hub"], order, "_p", max(16, deal // 32))
    placed = ranked.join(spans, "_hub").withColumn("shard", F.element_at(F.filter("_ends", lambda e: e["hi"] > F.col("_p")), 1)["shard"]).drop("_ends", "_p")
    left = quota.join(cells.groupBy("shard").agg(F.sum("members").alias("load")), "shard", "left").select("shard", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("free"))
    filled = _placed(position(single, [], order, "_p", deal), "_p", _steps(left, "free")).drop("_p")
    keep = ["doc_id", "size", "text_crc32", "shard"]
    done = placed.select(*keep).unionByName(filled.select(*keep))
    slotted = position(done, ["shard"], _hash("doc_id", "text_crc32", F.lit("slot")), "slot", max(64, deal // n_shards))
    return slotted.select("doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
