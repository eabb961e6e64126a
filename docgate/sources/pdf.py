"""Text as a plain PDF: lines wrapped by display width, pages of a fixed number of lines, headings in a larger type."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.operators.folds import slices

# Fixed values of the page: columns and lines, the place of the first line, the step, type sizes by heading level.
COLUMNS, LINES = 62, 44
LEFT, HEADER_Y, TOP, STEP = 54, 796, 764, 16
SIZES = {1: 15, 2: 13, 3: 12}
FONT = (
    "<< /Type /Font /Subtype /Type0 /BaseFont /STSong-Light /Encoding /UniGB-UCS2-H /DescendantFonts [4 0 R] >>",
    "<< /Type /Font /Subtype /CIDFontType0 /BaseFont /STSong-Light /CIDSystemInfo << /Registry (Adobe) /Ordering (GB1) /Supplement 2 >> /FontDescriptor 5 0 R /DW 1000 >>",
    "<< /Type /FontDescriptor /FontName /STSong-Light /Flags 6 /FontBBox [0 -200 1000 900] /ItalicAngle 0 /Ascent 880 /Descent -120 /CapHeight 700 /StemV 80 >>",
)


def width(char: str) -> int:
    return 2 if unicodedata.east_asian_width(char) in "FW" else 1


def wrap(line: str, columns: int = COLUMNS) -> list[str]:
    """A line in parts of at most so many columns; wide characters take two."""
    out, used = [""], 0
    for char in line:
        if out[-1] and used + width(char) > columns:
            out.append("")
            used = 0
        out[-1] += char
        used += width(char)
    return [*(part.rstrip() for part in out[:-1]), out[-1]]


def layout(text: str, columns: int = COLUMNS) -> list[tuple[str, int]]:
    """(line, heading level or 0) of each printed line."""
    out = []
    for line in re.sub(r"\r\n?", "\n", text).strip().split("\n"):
        heading = re.fullmatch(r"(#{1,6})\s+(.+?)\s*", line)
        level = len(heading[1]) if heading else 0
        out += [(part, level) for part in wrap(heading[2] if heading else line.rstrip(), columns)]
    return out


def _shown(text: str, size: int, y: int) -> str:
    return f"/F1 {size} Tf\n1 0 0 1 {LEFT} {y} Tm <{text.encode('utf-16-be', errors='ignore').hex().upper()}> Tj"


def document(title: str, text: str, columns: int = COLUMNS, lines: int = LINES) -> bytes:
    """The bytes of a PDF 1.4."""
    printed = layout(text, columns)
    pages = [printed[i : i + lines] for i in range(0, len(printed), lines)]
    first = 3 + len(FONT)
    kids = " ".join(f"{first + 2 * i + 1} 0 R" for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), *(f.encode() for f in FONT)]
    for number, page in enumerate(pages, 1):
        body = [_shown(f"{title}  第 {number}/{len(pages)} 页", 11, HEADER_Y), *(_shown(line, SIZES.get(level, 11), TOP - STEP * k) for k, (line, level) in enumerate(page))]
        content = "\n".join(["BT", *body, "ET"]).encode()
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for number, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """doc_id, pages and pdf (bytes) for each row; a null text makes an empty page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            made = [document(title or "", text) for title, text in zip(batch.column("title").to_pylist(), texts, strict=True)]
            pages = [-(-len(layout(t)) // LINES) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pages, pa.int32()), pa.array(made, pa.binary())], ["doc_id", "pages", "pdf"])

    title = F.col(title_col) if title_col else F.col(id_col).cast("string")
    rows = df.select(F.col(id_col).alias("doc_id"), title.alias("title"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("pages", T.IntegerType()), T.StructField("pdf", T.BinaryType())]))
