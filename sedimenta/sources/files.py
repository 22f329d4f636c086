"""Files as tables: paths, texts, manifests, flattened CSV and JSON. Any path that Spark's file systems reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that are read by default, and names of types.
EXTENSIONS = ("txt", "pdf", "md", "html", "htm", "xbrl")
TYPES = {"txt": "text", "md": "markdown", "html": "HTML", "htm": "HTML", "xbrl": "XBRL", "pdf": "PDF", "docx": "Word", "doc": "Word", "csv": "CSV", "json": "JSON", "yaml": "YAML", "yml": "YAML"}


def scan(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = True) -> DataFrame:
    """``path``, ``extension``, ``size``, ``modified``, ``content`` of the files whose lower-cased extension is wanted.

    Columns that are not asked for are not read: a listing never opens a file.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return f.select("path", ext.alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content").where(F.col("extension").isin(*extensions))


def texts(files: DataFrame, charset: str = "UTF-8") -> DataFrame:
    """``path``, ``extension``, ``text``: bytes that are no UTF-8 become the replacement sign."""
    text = F.make_valid_utf8(F.col("content").cast("string")) if charset == "UTF-8" else F.decode("content", charset)
    return files.select("path", "extension", text.alias("text"))


def manifest(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("hash"), "size", "modified")


def type_label(extension: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(F.element_at(m, F.col(extension)), F.lit("Unknown type"))


def stats(t: DataFrame) -> DataFrame:
    """Count, total and mean length and distinct folders by extension."""
    n = F.char_length("text")
    return t.groupBy("extension").agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.round(F.avg(n), 6).alias("average"), F.count_distinct(F.regexp_extract("path", "^(.*)/", 1)).alias("folders"))


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Each row of CSV files with a header as one text, values joined by commas; ``spark.read.csv`` gives the columns."""
    d = spark.read.option("header", True).csv(path)
    return d.select(F.concat_ws(",", *d.columns).alias("line"))


def json_text(spark: SparkSession, path: str) -> DataFrame:
    """JSON files as indented text."""
    d = spark.read.option("multiLine", True).json(path)
    return d.select(F.to_json(F.struct(*d.columns), {"pretty": "true"}).alias("text"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by type and edges by type, so that a type is read alone."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
