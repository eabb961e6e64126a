import hashlib

import pytest
from pyspark.sql import functions as F

from docgate.sources import delivery


def test_a_delivery_is_whole_or_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    gated = spark.createDataFrame([(i, i != 3, f"# 书 {i}\n") for i in range(6)], "doc_id long, accepted boolean, text string").repartition(3)
    sources = spark.createDataFrame([(i, f"/in/a b {i}.pdf", f"hash{i}") for i in range(6)], "doc_id long, path string, source_sha256 string")
    pdfs = spark.createDataFrame([(1, bytearray(b"%PDF"))], "doc_id long, pdf binary")

    broken = gated.withColumn("text", F.when(F.col("doc_id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        delivery.publish(broken, folder, sources, pdfs)
    left = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert left == []

    delivery.publish(gated, folder, sources, pdfs)
    assert sorted(p.name for p in (tmp_path / "out/markdown").iterdir()) == [f"a_b_{i}.md" for i in (0, 1, 2, 4, 5)]
    assert [p.read_bytes() for p in (tmp_path / "out/pdf").iterdir()] == [b"%PDF"]
    rows = {r.source_path: r for r in delivery.manifest(spark, folder).collect()}
    assert len(rows) == 5 and "/in/a b 3.pdf" not in rows
    sha = lambda x: hashlib.sha256(x).hexdigest()
    one = rows["/in/a b 1.pdf"]
    assert (one.source_sha256, one.final_markdown_sha256, one.pdf_sha256) == ("hash1", sha("# 书 1\n".encode()), sha(b"%PDF"))
    assert one.binding_sha256 == sha(f"hash1:{one.final_markdown_sha256}".encode())

    # a second delivery of two documents is appended; the newest of each source counts
    again = gated.filter("doc_id < 2").withColumn("text", F.concat("text", F.lit("新\n")))
    delivery.publish(again, folder, sources, pdfs)
    assert delivery.manifest(spark, folder).count() == 7
    newest = {r.source_path: r.final_markdown_sha256 for r in delivery.delivered(spark, folder).collect()}
    assert len(newest) == 5 and newest["/in/a b 0.pdf"] == sha("# 书 0\n新\n".encode())
    assert (tmp_path / "out/markdown/a_b_0.md").read_text() == "# 书 0\n新\n"
    assert list((tmp_path / "out/_staged").iterdir()) == []
