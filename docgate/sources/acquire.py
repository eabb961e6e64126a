"""Texts from files that outside programs read: page counts, splits, conversions and remote recognition, all injected.

Every program is a plain function that travels to the executors; rows carry bytes in slices of a bounded size. A failure
is a row with an error, never a lost task. What has been done before is a table, and only the rest is done.
"""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.functions.dialect import over
from docgate.operators.folds import slices
from docgate.plans import relational

BATCH = 8
RETRY = (408, 429, 500, 502, 503, 504)


def _mapped(df: DataFrame, make: Callable[[bytes], list[dict]], columns: str) -> DataFrame:
    """df: (path, content). A row for each that make returns, with error null; or one row with the error."""
    schema = T.StructType([T.StructField("path", T.StringType()), *T._parse_datatype_string(f"{columns}, error string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for whole in batches:
            for batch in slices(whole, "content"):
                rows: list[dict] = []
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    try:
                        rows += [{"path": path, "error": None} | r for r in make(content or b"")]
                    except Exception as e:  # whatever the program does
                        rows.append({"path": path, "error": str(e)[:500] or type(e).__name__})
                yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    return df.select("path", "content").mapInArrow(run, schema)


def count_pages(content: bytes) -> int:
    """Pages of a PDF that doesn't hide its objects in streams."""
    found = len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", content))
    if not content.startswith(b"%PDF") or not found:
        raise ValueError("no page found")
    return found


def pages(files: DataFrame, count: Callable[[bytes], int] = count_pages, fallback: Callable[[bytes], int] | None = None) -> DataFrame:
    """path, pages, error: by the first counter, or by the second where that fails."""

    def make(content: bytes) -> list[dict]:
        try:
            return [{"pages": count(content)}]
        except Exception:
            if fallback is None:
                raise
            return [{"pages": fallback(content)}]

    return _mapped(files, make, "pages int")


def split(files: DataFrame, cut: Callable[[bytes, int, int], bytes], count: Callable[[bytes], int] = count_pages, most: int = 50) -> DataFrame:
    """path, segment, first_page, last_page, content, error: each file in parts of at most so many pages."""

    def make(content: bytes) -> list[dict]:
        starts = range(1, count(content) + 1, most)
        return [{"segment": k, "first_page": a, "last_page": (b := min(a + most - 1, count(content))), "content": cut(content, a, b)} for k, a in enumerate(starts, 1)]

    return _mapped(files, make, "segment int, first_page int, last_page int, content binary")


def converted(files: DataFrame, convert: Callable[[bytes], bytes], cache: DataFrame | None = None) -> DataFrame:
    """path, made, error: files as another format, those that the cache (path, made) has taken from there."""
    rest = files if cache is None else files.join(cache.select("path"), "path", "left_anti")
    made = _mapped(rest, lambda content: [{"made": convert(content)}], "made binary")
    return made if cache is None else made.unionByName(cache.join(files.select("path"), "path", "left_semi").select("path", "made", F.lit(None).cast("string").alias("error")))


def zipped_markdown(content: bytes) -> str:
    """The text of the first entry of an archive whose name ends in full.md."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        name = next((n for n in archive.namelist() if n.endswith("full.md")), None)
        if name is None:
            raise ValueError("no full.md in the archive")
        return archive.read(name).decode("utf-8", "replace")


def unzipped(files: DataFrame) -> DataFrame:
    """path, text, error."""
    return _mapped(files, lambda content: [{"text": zipped_markdown(content)}], "text string")


class Remote(Protocol):
    def recognise(self, items: list[tuple[str, bytes]]) -> dict[str, str]:
        """Texts by data id, for a batch of (data id, bytes)."""
        ...


def with_retries(do: Callable[[], dict], attempts: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """do, again after a pause that grows with each attempt where its error has a status that may pass, or none."""
    for n in range(1, attempts + 1):
        try:
            return do()
        except Exception as e:
            if n == attempts or getattr(e, "status", RETRY[0]) not in RETRY:
                raise
            sleep(pause * n)
    raise AssertionError


def recognised(segments: DataFrame, client: Remote, done: DataFrame | None = None, size: int = BATCH, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """segments: (path, segment, content). path, segment, data_id, text, error, in any order: batches of `size` segments go to the client,
    those that `done` (data_id, text) holds don't. A batch that fails gives each of its segments the error."""
    named = over(segments.withColumn("name", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)), lambda d, x: f"SELECT path, segment, content, {relational.data_id(d, 'name', 'segment')} AS data_id FROM {x}")
    rest = named if done is None else named.join(done.select("data_id"), "data_id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, size):
                batch = whole.slice(lo, size)
                ids = batch.column("data_id").to_pylist()
                try:
                    found, error = with_retries(lambda: client.recognise(list(zip(ids, batch.column("content").to_pylist(), strict=True))), attempts, pause), None  # noqa: B023
                except Exception as e:
                    found, error = {}, str(e)[:500] or type(e).__name__
                texts = [found.get(i) for i in ids]
                errors = [None if t is not None else error or "no result" for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("segment"), pa.array(ids), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "segment", "data_id", "text", "error"])

    made = rest.mapInArrow(run, "path string, segment int, data_id string, text string, error string")
    if done is None:
        return made
    return made.unionByName(named.join(done, "data_id").select("path", "segment", "data_id", "text", F.lit(None).cast("string").alias("error")))


def merged(texts: DataFrame) -> DataFrame:
    """path, text, complete: segments without space around them, in order, with blank lines between; complete if none failed."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = texts.select("path", "segment", bare.alias("bare"), "error")
    parts = F.array_sort(F.collect_list(F.struct("segment", "bare")))
    return rows.groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x["bare"]), "\n\n").alias("text"), F.every(F.col("error").isNull()).alias("complete"))


def largest(outputs: DataFrame) -> DataFrame:
    """outputs: (path, output, text). Of the texts that a parser wrote for a file, the longest; by name where several are."""
    order = Window.partitionBy("path").orderBy(F.length("text").desc(), "output")
    return outputs.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
