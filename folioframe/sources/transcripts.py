"""Page transcripts as a table partitioned by source, and as a tree of Markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Stated, so that sources made of digits stay strings.
PAGES = StructType(
    [StructField("page", IntegerType()), StructField("text", StringType()), StructField("image_path", StringType()), StructField("source", StringType())]
)
MANIFEST = "source string, pages array<struct<page:int,image_path:string>>, _corrupt_record string"


def save_pages(pages: DataFrame, path: str) -> None:
    """Writes (source, page, text, image_path); every source that is written replaces all of its old pages."""
    columns = pages.select(*[F.col(f.name).cast(f.dataType) for f in PAGES])
    columns.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def load_pages(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Pages of one source or of all; the partition of a source is pruned."""
    pages = spark.read.schema(PAGES).parquet(path)
    return pages.where(F.col("source") == source) if source is not None else pages


def list_sources(spark: SparkSession, path: str) -> DataFrame:
    """(source), read from partitions alone."""
    return load_pages(spark, path).select("source").distinct()


def page_lists(spark: SparkSession, path: str) -> DataFrame:
    """(source, pages): every source with its pages in order, as a manifest lists them; sources in order."""
    pages = load_pages(spark, path).groupBy("source").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    return pages.orderBy("source")


def load_all_pages(spark: SparkSession, path: str) -> DataFrame:
    """All pages, in order of source and page."""
    return load_pages(spark, path).orderBy("source", "page")


def remove_source(spark: SparkSession, path: str, source: str) -> bool:
    """Deletes a source's partition by the file system that holds the table; False if there is none."""
    jvm = spark._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(source)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/source={name}")
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))


def load_tree(spark: SparkSession, path: str) -> DataFrame:
    """(source, page, text, image_path) of folders with a manifest.json and p<n>.md files.

    Sources are named by the manifests.  Broken manifests and pages without a file are skipped.
    """
    def folder(name):
        return F.regexp_extract(name, r"([^/]+)/[^/]+$", 1)

    manifests = spark.read.schema(MANIFEST).json(f"{path}/*/manifest.json", multiLine=True).withColumn("folder", folder(F.col("_metadata.file_path")))
    listed = manifests.where("source IS NOT NULL").select("source", "folder", F.inline("pages"))
    files = spark.read.text(f"{path}/*/p*.md", wholetext=True).select(
        folder(F.col("_metadata.file_path")).alias("folder"), F.regexp_extract("_metadata.file_name", r"^p(\d+)\.md$", 1).try_cast("int").alias("page"), F.col("value").alias("text")
    )
    return listed.join(files, ["folder", "page"]).select("source", "page", "text", "image_path")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """(q, source, kind, evidence map<int,string>): evaluation cases of one page or several, a line of JSON each."""
    schema = "q string, source string, page int, pages array<int>, kind string, evidence string"
    raw = spark.read.schema(schema).json(path)
    several = F.from_json("evidence", "map<string,string>")
    one = F.create_map("page", "evidence")
    keyed = F.transform_keys(several, lambda k, v: k.cast("int"))
    return raw.select("q", "source", F.coalesce("kind", F.lit("single")).alias("kind"), F.when(F.col("pages").isNull(), one).otherwise(keyed).alias("evidence"))


def load_diagram_index(spark: SparkSession, path: str) -> DataFrame:
    """(source, page, title, gist, tags, media, symbols, image_path) of a JSON object of sources, each an object of pages."""
    entry = "struct<title:string,gist:string,tags:array<string>,media:array<string>,symbols:map<string,int>,image_path:string>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,map<string,{entry}>>")).alias("source", "pages"))
    rows = raw.select("source", F.explode("pages").alias("page", "e"))
    none, no_symbols = F.array().cast("array<string>"), F.create_map().cast("map<string,int>")
    return rows.select(
        "source", F.col("page").cast("int").alias("page"), F.coalesce("e.title", F.lit("")).alias("title"), F.coalesce("e.gist", F.lit("")).alias("gist"),
        F.coalesce("e.tags", none).alias("tags"), F.coalesce("e.media", none).alias("media"), F.coalesce("e.symbols", no_symbols).alias("symbols"), F.col("e.image_path").alias("image_path"),
    )
