"""WARC archives with an index, written and read back by byte ranges.

Pages are matched by the SHA-1 of their payload: an aggregate finds each repeated digest's largest page_id, which
becomes a `response`; the others become `revisit` records that name it and carry no payload. Every task writes
archives of its own into the shared folder (one gzip member per record, so that any record can be read alone) and
returns an index row per record: archive, offset, length, URL and digest. The index is a table; archives that a lost
or repeated task left behind are in no index row.

A read starts from index rows: they are dealt out by stretches of `UNIT` archive bytes, to as many tasks as the wanted
bytes ask for (one sum over the index tells), and sorted by archive and offset; neighbouring ranges are joined into one
read of a bounded size, and each record is unpacked, parsed and its payload checked against its digest.

Defined results: null html is an empty payload; payloads below `least` bytes are never revisits; of rows equal in
page_id and payload one is the response (of the largest url); a null page_id is smaller than any other; a null URL is left out of the
record; an empty table gives an empty index. A payload of any length is one record, held whole by the task that writes or reads it.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.llm.common import new_path, slices, small_batches, written

#: Payloads of at least so many bytes may be revisits.
LEAST = 0
#: Bytes of an archive, about; of a joined read; of unwanted records read over rather than skipped.
ARCHIVE, READ, GAP = 512 << 20, 8 << 20, 64 << 10
#: Archive bytes that are dealt to a task in one piece, and bytes of a read's task, about.
UNIT, TASK = 16 << 20, 128 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool) -> bytes:
    """One WARC/1.1 record, unpacked."""
    from urllib.parse import quote

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe="!#$%&'()*+,/:;=?@[]~")}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """The headers, the payload's length as its HTTP header has it, and the payload of an unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, size, payload


def plan(df: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """(page_id, url, payload, top, revisit): each row with the page that has its payload's response."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    same = rows.filter(F.octet_length("payload") >= least).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    top = written(
        same.groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("rows")).filter("rows > 1").select("digest", F.col("top.page_id").alias("top"), F.col("top.n").alias("n_top")),
        "repeated-payloads",
    )
    found = rows.join(top, "digest", "left").withColumn("revisit", F.col("n_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")))
    if not top.filter("n_top > 1").isEmpty():  # rows repeated as a whole: all but one revisit it
        tied = F.coalesce(F.col("n_top") > 1, F.lit(False)) & ~F.col("revisit")
        alike = written(found.filter(tied).withColumn("row", F.monotonically_increasing_id()), "tied-pages")
        best = F.max(F.struct(F.coalesce("url", F.lit("")).alias("url"), "row")).alias("best")
        first = alike.groupBy("digest").agg(best).select("digest", F.col("best.row").alias("first"))
        alike = alike.join(first, "digest").withColumn("revisit", F.col("row") != F.col("first"))
        found = found.filter(~tied).unionByName(alike.drop("row", "first"))
    return found.select("page_id", "url", "payload", "top", "revisit")


def write(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes the archives and returns their index: page_id, archive, offset, length, url, digest, record_type, refers_to."""
    spark = df.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "warc")
    id_type = df.schema[id_col].dataType
    kinds = (("page_id", id_type), ("archive", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()), ("url", T.StringType()), ("digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", id_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at, number = None, "", 0, 0
        try:
            for whole in batches:
                for batch in slices(whole, "payload", 8 << 20):
                    where = []
                    columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "top", "revisit")]
                    for page_id, url, payload, top, revisit in zip(*columns, strict=True):
                        if out is None or at >= ARCHIVE:
                            if out is not None:
                                out.close()
                            name, at, number = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz", 0, number + 1
                            out = store.open_output_stream(f"{root}/{name}", compression=None)
                        digest = base32_sha1(payload)
                        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                        data = pack.compress(record(page_id, url, payload, digest, top, revisit)) + pack.flush()
                        out.write(data)
                        where.append((name, at, len(data), digest, "revisit" if revisit else "response", top if revisit else None))
                        at += len(data)
                    names, offsets, sizes, digests, types, refers = zip(*where, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("page_id"), pa.array([f"{folder}/{n}" for n in names]), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), batch.column("url"), pa.array(digests), pa.array(types), pa.array(refers, batch.column("page_id").type)],
                        [k for k, _ in kinds],
                    )
        finally:
            if out is not None:
                out.close()

    return written(plan(df, id_col, url_col, payload_col, least).mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds])), "warc-index")


def read(index: DataFrame, most: int = READ, gap: int = GAP, unit: int = UNIT, task: int = TASK) -> DataFrame:
    """The records of index rows: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit)."""
    id_type = index.schema["page_id"].dataType
    kinds = (("page_id", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.StringType()), ("payload", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri("file:///")[0]
        name, file = None, None

        def one(data: bytes) -> tuple:
            fields, size, payload = parse(zlib.decompress(data, 31))
            digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
            if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
                raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
            return fields.get("X-Page-ID"), size, digest, fields["WARC-Type"], fields.get("X-Refers-To-Page-ID"), None if revisit else payload

        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
            start = 0
            while start < len(rows):
                stop = start + 1
                while stop < len(rows) and rows[stop][0] == rows[start][0] and 0 <= rows[stop][1] - (rows[stop - 1][1] + rows[stop - 1][2]) <= gap and rows[stop][1] + rows[stop][2] - rows[start][1] <= most:
                    stop += 1
                archive, first, _ = rows[start]
                if archive != name:
                    store, path = fs.FileSystem.from_uri(archive)
                    name, file = archive, store.open_input_file(path)
                data = file.read_at(rows[stop - 1][1] + rows[stop - 1][2] - first, first)
                found = [one(data[at - first : at - first + size]) for _, at, size in rows[start:stop]]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()))], [k for k, _ in kinds])
                start = stop

    # a number for each archive's stretch, and from their sum the number of tasks
    wanted, pieces = index.agg(F.sum("length"), F.count_distinct("archive", F.floor(F.col("offset") / unit))).first()
    tasks = max(1, min(pieces, max(math.ceil((wanted or 0) / task), index.sparkSession.sparkContext.defaultParallelism)))
    place = index.select("archive", "offset", "length", F.floor(F.col("offset") / unit).alias("unit"))
    order = place.repartition(tasks, "archive", "unit").sortWithinPartitions("archive", "offset").drop("unit")
    out = order.mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds]))
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))
