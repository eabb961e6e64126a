"""Reading sources and writing deliveries, as DataFrames from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The suffixes of sources, and what kind each is.
KINDS = {"md": "markdown", "pdf": "pdf", "doc": "word", "docx": "word"} | dict.fromkeys(("png", "jpg", "jpeg", "jp2", "webp", "gif", "bmp", "ppt", "pptx", "xls", "xlsx"), "mineru_only")
GENERATED = ("process", "md", "pdf")

CALL_LOG = (
    "document_id string, call_index int, stage string, model string, request_id string, started_at string, finished_at string, duration_seconds double, status string, "
    "retry_count int, input_chars int, output_chars int, estimated_cost double, estimated_cost_total double, error string, code string, fallback_used boolean"
)
BATCH_STATE = "index int, total int, source_path string, output_dir string, status string, started_at string, finished_at string, result_status string, error string"


#: Parts of names that earlier runs gave their outputs.
GENERATED_NAMES = (".final.", ".draft.", ".pre_llm.", ".cleaned.")


def discover(spark: SparkSession, folder: str, skip_generated: bool = False, output: str | None = None) -> DataFrame:
    """The sources below a folder: path, name, kind, size, in natural order (leading number first, then name).

    Without those that earlier runs made, if wanted (by folder and by name), and without what lies below an output folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.*").load(folder).select("path", F.col("length").alias("size"))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[suffix]
    named = found.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("kind", kind).filter("kind is not null")
    if skip_generated:
        named = named.filter(~F.col("path").rlike(f"/(?:{'|'.join(GENERATED)})/"))
        for mark in GENERATED_NAMES:
            named = named.filter(~F.contains("name", F.lit(mark)))
    if output is not None:
        named = named.filter(~F.contains("path", F.lit(output.rstrip("/") + "/")))
    number = F.when(F.col("name").rlike(r"^\d"), F.regexp_extract("name", r"^(\d+)", 1).cast("long"))
    return named.orderBy(number.asc_nulls_last(), F.lower("name"), "path").select("path", "name", "kind", "size")


def texts(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """doc_id (a hash of the path, so that equal names in different folders stay apart), path, text. Bytes that aren't UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.expr("make_valid_utf8(cast(content as string))").alias("text"), F.sha2("content", 256).alias("source_sha256"))


def log(spark: SparkSession, path: str, schema: str = CALL_LOG) -> DataFrame:
    """JSON lines with malformed ones left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def stem(name: F.Column):
    """A name that any file system takes."""
    bare = F.regexp_replace(F.regexp_replace(name, r'(?U)[\\/:*?"<>|\s]+', "_"), r"^[._]+|[._]+$", "")
    return F.when(bare == "", "document").otherwise(bare)


def deliver(gated: DataFrame, folder: str, sources: DataFrame | None = None) -> None:
    """Accepted texts and a manifest with their hashes, as Parquet by status. Nothing else of a rejected document is written than its codes.

    With sources (doc_id, path, source_sha256), the manifest binds each delivery to its source: source path, safe stem, and the hashes of source, text and both together."""
    final = F.when(F.col("accepted"), F.sha2("text", 256))
    rows = gated.select(
        "doc_id", F.when(F.col("accepted"), "passed").otherwise("needs_revision").alias("status"), F.array_join("blocking", ",").alias("blocking"), F.array_join("warnings", ",").alias("warnings"),
        final.alias("final_sha256"), F.when(F.col("accepted"), F.col("text")).alias("text"),
    )
    if sources is not None:
        named = sources.select("doc_id", F.col("path").alias("source_path"), stem(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("stem"), "source_sha256")
        rows = rows.join(named, "doc_id", "left").withColumn("binding_sha256", F.when(F.col("final_sha256").isNotNull(), F.sha2(F.concat_ws(":", "source_sha256", "final_sha256"), 256)))
    rows.write.partitionBy("status").mode("overwrite").parquet(folder)


def delivered_before(texts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Of texts (doc_id, path, text, source_sha256), those whose source and path were delivered, and whose delivery is bound to them still."""
    whole = manifest.filter("status = 'passed' and binding_sha256 = sha2(concat_ws(':', source_sha256, final_sha256), 256)")
    return texts.join(whole.select(F.col("source_path").alias("path"), "source_sha256").distinct(), ["path", "source_sha256"], "left_semi")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def latest_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key of an append-only log."""
    newest = F.max_by(F.struct("*"), order).alias("row")
    return rows.groupBy(F.col(key).alias("__key")).agg(newest).select("row.*")
