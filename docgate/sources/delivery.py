"""Delivery as a sink of its own: Markdown and PDF files under their names, and a manifest that a delivery appends to.

A task writes its files into a staging folder of the write and tells the driver their names and hashes; nothing is
visible until all tasks are done. Then each file is moved to its place, and the manifest gets one more part, which is
written aside and renamed, so that a row stands there only if its files do. If a task fails for good, the staging folder
goes and neither a file nor a row is left. A task that is run again writes under names of its own.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT = "docgate_delivery"
COLUMNS = "doc_id, source_path, stem, source_sha256, text, pdf"
MANIFEST = "document_id string, accepted boolean, status string, source_path string, source_sha256 string, final_markdown_path string, final_markdown_sha256 string, text_pdf_path string, pdf_sha256 string, binding_sha256 string, delivered_at string"


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: (staged path, final path) of each file, and the manifest's rows."""

    files: list[tuple[str, str]] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)


class DeliveryWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def _place(self):
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(self.folder)
        return fs, root.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Staged:
        fs, root = self._place()
        aside = f"{root}/_staged/{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(aside, recursive=True)
        out = Staged()
        for k, row in enumerate(iterator):
            text = (row.text or "").encode()
            if not text:
                continue  # an empty document isn't delivered
            final, pdf = f"{root}/markdown/{row.stem}.md", f"{root}/pdf/{row.stem}.pdf" if row.pdf else ""
            for number, (data, place) in enumerate(((text, final), (bytes(row.pdf or b""), pdf))):
                if place:
                    staged = f"{aside}/{k}-{number}"
                    with fs.open_output_stream(staged) as sink:
                        sink.write(data)
                    out.files.append((staged, place))
            text_hash, source_hash = digest(text), row.source_sha256 or ""
            out.rows.append(
                {
                    "document_id": "" if row.doc_id is None else str(row.doc_id), "accepted": True, "status": "delivered", "source_path": row.source_path, "source_sha256": source_hash, "final_markdown_path": final, "final_markdown_sha256": text_hash,
                    "text_pdf_path": pdf, "pdf_sha256": digest(bytes(row.pdf)) if row.pdf else "", "binding_sha256": digest(f"{source_hash}:{text_hash}".encode()),
                }
            )
        return out

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = self._place()
        for name in ("markdown", "pdf", "manifest"):
            fs.create_dir(f"{root}/{name}", recursive=True)
        rows = [r for m in messages if m is not None for r in m.rows]
        for staged, place in (f for m in messages if m is not None for f in m.files):
            fs.move(staged, place)
        if rows:
            now = datetime.now(UTC).isoformat(timespec="microseconds")
            aside = f"{root}/_staged/{self.job}/manifest"
            with fs.open_output_stream(aside) as sink:
                sink.write("".join(json.dumps(r | {"delivered_at": now}, ensure_ascii=False, sort_keys=True) + "\n" for r in rows).encode())
            fs.move(aside, f"{root}/manifest/{now.replace(':', '')}-{self.job}.json")
        fs.delete_dir(f"{root}/_staged/{self.job}")

    def abort(self, messages: list[Staged | None]) -> None:
        from pyarrow.fs import FileType

        fs, root = self._place()
        if fs.get_file_info(f"{root}/_staged/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{root}/_staged/{self.job}")


class Delivery(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a delivery only appends")
        return DeliveryWriter(self.options["folder"])


def publish(gated: DataFrame, folder: str, sources: DataFrame, pdfs: DataFrame | None = None) -> None:
    """Delivers the accepted documents of gated (doc_id, accepted, text) under their sources' stems. sources: doc_id, path, source_sha256; pdfs: doc_id, pdf. folder: a URI that all tasks reach."""
    from docgate.sources.files import stem

    gated.sparkSession.dataSource.register(Delivery)
    named = sources.select("doc_id", F.col("path").alias("source_path"), stem(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("stem"), "source_sha256")
    rows = gated.filter("accepted").select("doc_id", "text").join(named, "doc_id")
    rows = rows.join(pdfs.select("doc_id", "pdf"), "doc_id", "left") if pdfs is not None else rows.withColumn("pdf", F.lit(None).cast("binary"))
    rows.select(*COLUMNS.split(", ")).write.format(FORMAT).mode("append").option("folder", folder).save()


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivery there has been, a row each."""
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    """The newest delivery of each source."""
    from docgate.sources.files import latest_rows

    return latest_rows(manifest(spark, folder), "source_path", "delivered_at")
