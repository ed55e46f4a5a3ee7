"""Archive metadata: gene sets, run tables, manifests, JSON, XML and HTML texts, and file verification."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import need

GENE_SETS = T.StructType([T.StructField(c, T.StringType()) for c in ("gsName", "gsGene", "gsRange", "gsSource", "gsCitation")])
MANIFEST = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("run_accession", "biosample", "sample_name")] + [T.StructField("size_bytes", T.LongType()), T.StructField("md5", T.StringType()), T.StructField("url", T.StringType())]
)


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """Gene-set CSV; a byte-order mark before the header does not matter, an empty range is null, a header alone gives no rows."""
    return spark.read.schema(GENE_SETS).option("header", True).option("enforceSchema", True).option("escape", '"').csv(path)


def read_run_info(spark: SparkSession, path: str, ids: int | None = None) -> DataFrame:
    """Run table, all columns as text; checked for the number of ids asked for and for a single project, from two numbers."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    need(df, "Run", "BioProject")
    rows, projects = df.agg(F.count(F.lit(1)), F.countDistinct("BioProject")).first()
    if ids is not None and rows != ids or projects > 1:
        raise ValueError(f"{rows} rows of {projects} projects; {ids} of one were asked for")
    return df


def write_manifest(df: DataFrame, path: str) -> None:
    """Tab-separated, columns in schema order, sorted by run."""
    need(df, *MANIFEST.names)
    df.select(*MANIFEST.names).orderBy("run_accession").write.option("sep", "\t").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("sep", "\t").option("header", True).csv(path)


def write_new(df: DataFrame, path: str) -> bool:
    """Writes only if nothing is there; an empty table that is there already is an error."""
    try:
        empty = df.sparkSession.read.schema(df.schema).parquet(path).isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df.write.mode("errorifexists").parquet(path)
        return True
    if empty:
        raise ValueError(f"{path} is empty")
    return False


def valid_project(accession: Column) -> Column:
    return F.upper(F.trim(accession)).rlike("^PRJNA[0-9]+$")


def quoted(text: Column) -> Column:
    """Percent-encoding of all but letters, digits, _ . - ~ and /."""
    form = F.url_encode(text)  # of forms: a space is a plus, * stays and ~ does not
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        form = F.replace(form, F.lit(a), F.lit(b))
    return form


def moved_url(url: Column, old: str, new: str, name: Column | None = None) -> Column:
    """A URL with one prefix in place of another, wherever it stands; with ``name``, quoted, as its last part."""
    at = F.replace(url, F.lit(old), F.lit(new))
    return at if name is None else F.concat(F.regexp_replace(at, "/[^/]*$", "/"), quoted(name))


def series_prefix(accession: Column) -> Column:
    """The archive's folder of a series: its last three characters become nnn."""
    return F.concat(F.substring(accession, F.lit(1), F.greatest(F.length(accession) - 3, F.lit(0))), F.lit("nnn"))


def series_ids(xml: Column) -> Column:
    """Sorted distinct node texts that are a series accession."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(xml, F.lit(r">\s*(GSE[0-9]+)\s*<"), F.lit(1))))


def links(html: Column, keep_all: bool = False) -> Column:
    """Sorted distinct hrefs of anchors, without those that start with / ? # or end with /."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))))
    return found if keep_all else F.filter(found, lambda x: ~x.rlike("^[/?#]") & ~x.endswith("/"))


def run_location(response: Column) -> Column:
    """Struct (link, size, md5) of the first sra file on s3 in a locator response; null if there is none."""
    kind = "struct<result:array<struct<files:array<struct<type:string,size:bigint,md5:string,locations:array<struct<service:string,link:string>>>>>>>"
    parsed = F.from_json(response, kind)
    file = F.get(F.filter(F.get(parsed["result"], F.lit(0))["files"], lambda f: f["type"] == "sra"), F.lit(0))
    place = F.get(F.filter(file["locations"], lambda x: x["service"] == "s3"), F.lit(0))
    return F.when(place["link"].isNotNull(), F.struct(place["link"].alias("link"), file["size"].alias("size_bytes"), file["md5"].alias("md5")))


def with_sizes(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Expected sizes from the listing's archive rows, by name."""
    sizes = listing.filter(F.col("kind") == "Archive").select("name", F.col("size").cast("long").alias("_size"))
    return files.join(sizes, "name", "left").withColumn("size_bytes", F.coalesce("size_bytes", "_size")).drop("_size")


def verify(expected: DataFrame, observed: DataFrame, key: str = "path") -> DataFrame:
    """Status of each expected file: missing, size_mismatch, md5_mismatch or verified; what is not expected is not compared."""
    o = observed.select(key, F.col("size_bytes").alias("_size"), F.lower("md5").alias("_md5"), F.lit(True).alias("_there"))
    status = (
        F.when(F.col("_there").isNull(), "missing").when(F.col("size_bytes").isNotNull() & (F.col("size_bytes") != F.col("_size")), "size_mismatch")
        .when(F.col("md5").isNotNull() & (F.lower("md5") != F.col("_md5")), "md5_mismatch").otherwise("verified")
    )
    return expected.join(o, key, "left").select(key, status.alias("status"))


def to_fetch(expected: DataFrame, observed: DataFrame, key: str = "path") -> DataFrame:
    """Expected files that are not verified yet."""
    return expected.join(verify(expected, observed, key).filter("status = 'verified'"), key, "left_anti")


def batches(df: DataFrame, order: str, size: int = 200) -> DataFrame:
    """Numbers batches of ``size`` rows in the order of a unique key, from counts of key ranges rather than in one task."""
    parts = df.select(order).repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    own = parts.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(order)))
    first = own.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return own.join(F.broadcast(first.select("_p", "_before")), "_p").select(order, F.floor((F.col("_r") + F.col("_before") - 1) / size).cast("long").alias("batch"))  # a row per partition
