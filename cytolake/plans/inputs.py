"""Operator inputs derived from the given tables, as DataFrames and as SQL common table expressions of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def sql(*names: str) -> str:
    """WITH clause of the named inputs and of those they need."""
    seen: dict[str, str] = {}

    def add(n: str) -> None:
        needs, body = _SQL[n]
        for x in needs:
            add(x)
        seen.setdefault(n, body)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({b})" for n, b in seen.items())


class Tables:
    """The tables of one folder, and what is derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    _SQL["counts"] = ((), "SELECT p_brand AS gene, CAST(s_nationkey AS VARCHAR) AS sample, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")

    def counts(self) -> DataFrame:
        rows = self["lineitem"].join(self["part"].select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(self["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        return rows.groupBy(F.col("p_brand").alias("gene"), F.col("s_nationkey").cast("string").alias("sample")).agg(F.sum("l_quantity").alias("value"))

    _SQL["expr"] = ((), "SELECT 'g' || (p_partkey // 10) AS gene, CAST(s_nationkey AS VARCHAR) AS sample, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")

    def expression(self) -> DataFrame:
        """A gene for every ten parts, so that genes grow with the table; a sample for each nation."""
        rows = self["lineitem"].join(self["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        return rows.groupBy(F.concat(F.lit("g"), F.floor(F.col("l_partkey") / 10).cast("string")).alias("gene"), F.col("s_nationkey").cast("string").alias("sample")).agg(F.sum("l_quantity").alias("value"))

    def sample_groups(self) -> DataFrame:
        """Samples in two groups and three batches, by nation."""
        n = F.col("n_nationkey")
        return self["nation"].select(n.cast("string").alias("sample"), F.when(n % 2 == 0, "even").otherwise("odd").alias("group"), F.concat(F.lit("b"), (n % 3).cast("string")).alias("batch"))

    _SQL["lens"] = ((), "SELECT p_brand AS gene, max(p_size) AS length FROM part GROUP BY 1")

    def transcripts(self) -> DataFrame:
        return self["part"].select(F.col("p_brand").alias("gene"), F.col("p_size").alias("tx_len"))

    _SQL["exons"] = ((), "SELECT p_brand AS gene, p_partkey AS s, p_partkey + p_size AS e FROM part")

    def exons(self) -> DataFrame:
        return self["part"].select(F.col("p_brand").alias("gene"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"))

    _SQL["studies"] = (
        (),
        "SELECT study, gene, CAST(((study * 37 + CAST(regexp_extract(gene, '([0-9]+)', 1) AS INTEGER) * 11) % 97) + 1 AS DOUBLE) / 98.0 AS p_val, ln(m / avg(m) OVER (PARTITION BY study)) AS log_fc"
        " FROM (SELECT s_nationkey AS study, p_brand AS gene, avg(l_extendedprice) AS m FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)",
    )

    def studies(self) -> DataFrame:
        from pyspark.sql import Window as W

        rows = self["lineitem"].join(self["part"].select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(self["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        g = rows.groupBy(F.col("s_nationkey").alias("study"), F.col("p_brand").alias("gene")).agg(F.avg("l_extendedprice").alias("_m"))
        key = (F.col("study") * 37 + F.regexp_extract("gene", "([0-9]+)", 1).cast("int") * 11) % 97 + 1
        return g.select("study", "gene", (key.cast("double") / 98.0).alias("p_val"), F.ln(F.col("_m") / F.avg("_m").over(W.partitionBy("study"))).alias("log_fc"))

    _SQL["vals"] = ((), "SELECT c_mktsegment AS grp, CAST(n_regionkey AS VARCHAR) AS variable, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")

    def values(self) -> DataFrame:
        c = self["customer"].select("c_custkey", "c_mktsegment", "c_nationkey").join(F.broadcast(self["nation"].select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
        return self["orders"].join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("grp"), F.col("n_regionkey").cast("string").alias("variable"), F.col("o_totalprice").alias("value"))

    _SQL["cells"] = ((), "SELECT vec_id AS cell_id, CAST(vec_id % 4 AS VARCHAR) AS sample, CAST(label AS VARCHAR) AS cluster, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings")

    def cells(self) -> DataFrame:
        return self["embeddings"].select(F.col("vec_id").alias("cell_id"), (F.col("vec_id") % 4).cast("string").alias("sample"), F.col("label").cast("string").alias("cluster"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))

    _SQL["near"] = (
        ("cells",),
        "SELECT sample, cluster, point, lag(point, 1, -1) OVER w AS p1, lead(point, 1, -1) OVER w AS p2, lead(point, 2, -1) OVER w AS p3 FROM (SELECT sample, cluster, row_number() OVER (PARTITION BY sample ORDER BY x, cell_id) - 1 AS point FROM cells) WINDOW w AS (PARTITION BY sample ORDER BY point)",
    )
    _SQL["edge"] = (("near",), "SELECT DISTINCT sample, least(point, q) AS point_1, greatest(point, q) AS point_2 FROM (SELECT sample, point, unnest([p1, p2, p3]) AS q FROM near) WHERE q <> -1")

    def neighbours(self) -> DataFrame:
        """Points numbered by x within the sample, each with the points beside it; -1 pads."""
        from pyspark.sql import Window as W

        n = self.cells().withColumn("point", F.row_number().over(W.partitionBy("sample").orderBy("x", "cell_id")) - 1)
        w = W.partitionBy("sample").orderBy("point")
        return n.withColumn("neigh", F.array("point", F.lag("point", 1, -1).over(w), F.lead("point", 1, -1).over(w), F.lead("point", 2, -1).over(w)))

    _SQL["grid"] = (
        (),
        "SELECT i.image, t.channel, CAST(r.i AS INTEGER) AS row, CAST(c.i AS INTEGER) AS col FROM (SELECT DISTINCT 'img' || (user_id // 15) AS image FROM events) i, (SELECT DISTINCT event_type AS channel FROM events) t, (SELECT unnest(range(15)) AS i) r, (SELECT unnest(range(24)) AS i) c",
    )
    _SQL["pixels"] = (
        ("grid",),
        "SELECT g.image, g.channel, g.row, g.col, coalesce(v, 0.0) AS v FROM grid g LEFT JOIN (SELECT 'img' || (user_id // 15) AS image, event_type, user_id % 15 AS r, event_id % 24 AS c, round(sum(value), 4) AS v FROM events GROUP BY 1, 2, 3, 4) e"
        " ON e.image = g.image AND e.event_type = g.channel AND e.r = g.row AND e.c = g.col",
    )

    def pixels(self) -> DataFrame:
        """An image for every 15 users: their events summed over a 15 x 24 grid for each type; empty squares are 0."""
        image = F.concat(F.lit("img"), F.floor(F.col("user_id") / 15).cast("string"))
        e = self["events"].select(image.alias("image"), F.col("event_type").alias("channel"), (F.col("user_id") % 15).cast("int").alias("row"), (F.col("event_id") % 24).cast("int").alias("col"), "value")
        sums = e.groupBy("image", "channel", "row", "col").agg(F.round(F.sum("value"), 4).alias("v"))
        types = e.agg(F.array_sort(F.collect_set("channel")).alias("_types"))  # a handful
        at = e.select("image").distinct().crossJoin(F.broadcast(types)).select("image", F.explode("_types").alias("channel"))
        grid = at.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(14)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(23))))
        return grid.join(sums, ["image", "channel", "row", "col"], "left").select("image", "channel", "row", "col", F.coalesce("v", F.lit(0.0)).alias("v"))

    _SQL["mask"] = (
        ("pixels",),
        "SELECT image, row, col, CAST(CASE WHEN s * count(*) OVER (PARTITION BY image) > sum(s) OVER (PARTITION BY image) THEN 1 + (row // 4) * 6 + col // 4 ELSE 0 END AS INTEGER) AS label FROM (SELECT image, row, col, CAST(sum(CAST(round(v * 100) AS BIGINT)) AS BIGINT) AS s FROM pixels GROUP BY 1, 2, 3)",
    )

    def mask(self) -> DataFrame:
        """Squares brighter than the mean of their image, labelled by blocks of 4 x 4; sums are in whole hundredths, so that the comparison is exact."""
        from pyspark.sql import Window as W

        at = self.pixels().groupBy("image", "row", "col").agg(F.sum(F.round(F.col("v") * 100).cast("long")).alias("_s"))
        own = W.partitionBy("image")
        bright = F.col("_s") * F.count(F.lit(1)).over(own) > F.sum("_s").over(own)
        return at.select("image", "row", "col", F.when(bright, 1 + F.floor(F.col("row") / 4) * 6 + F.floor(F.col("col") / 4)).otherwise(0).cast("int").alias("label"))

    _SQL["vecs"] = ((), "SELECT CAST(label AS VARCHAR) AS item, dim AS key, avg(v) AS value FROM (SELECT label, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1, 2")

    def vectors(self) -> DataFrame:
        """Mean embedding of each label, long."""
        e = self["embeddings"].select(F.col("label").cast("string").alias("item"), F.posexplode("embedding").alias("_k", "v"))
        return e.groupBy("item", (F.col("_k") + 1).alias("key")).agg(F.avg(F.col("v").cast("double")).alias("value"))

    _SQL["geno"] = ((), "SELECT o_custkey AS ind, p_type AS snp, count(*) % 3 AS dosage FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(*) % 3 > 0")
    _SQL["pheno"] = ((), "SELECT c_custkey AS ind, c_acctbal AS y FROM customer")

    def geno(self) -> DataFrame:
        rows = self["lineitem"].select("l_orderkey", "l_partkey").join(self["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(self["part"].select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        return rows.groupBy(F.col("o_custkey").alias("ind"), F.col("p_type").alias("snp")).agg((F.count(F.lit(1)) % 3).alias("dosage")).filter("dosage > 0")

    def pheno(self) -> DataFrame:
        return self["customer"].select(F.col("c_custkey").alias("ind"), F.col("c_acctbal").alias("y"))

    _SQL["coef"] = (
        (),
        "SELECT model, CAST(k AS INTEGER) AS term_pos, 't' || k AS term, d * k - t * (7 - k) + (q - 0.5) AS estimate, CAST(((num * 13 + k * 29) % 89) + 1 AS DOUBLE) / 90.0 AS pvalue,"
        " d * k - t * (7 - k) + (q - 0.5) - 0.196 * k AS lower, d * k - t * (7 - k) + (q - 0.5) + 0.196 * k AS upper FROM"
        " (SELECT p_brand AS model, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS num, avg(l_discount) AS d, avg(l_tax) AS t, avg(l_quantity) / 50 AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), (SELECT unnest(range(1, 7)) AS k)",
    )

    def coefficients(self) -> DataFrame:
        """Six made-up terms for each brand, from its means: a coefficient table of the shape that model fits leave."""
        g = self["lineitem"].join(self["part"].select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("model")).agg(F.avg("l_discount").alias("_d"), F.avg("l_tax").alias("_t"), (F.avg("l_quantity") / 50).alias("_q"))
        rows = g.withColumn("term_pos", F.explode(F.sequence(F.lit(1), F.lit(6))))
        k, e = F.col("term_pos"), F.col("_d") * F.col("term_pos") - F.col("_t") * (7 - F.col("term_pos")) + (F.col("_q") - 0.5)
        num = F.regexp_extract("model", "([0-9]+)", 1).cast("int")
        return rows.select("model", "term_pos", F.concat(F.lit("t"), k.cast("string")).alias("term"), e.alias("estimate"), (((num * 13 + k * 29) % 89 + 1).cast("double") / 90.0).alias("pvalue"), (e - 0.196 * k).alias("lower"), (e + 0.196 * k).alias("upper"))
