import re

from docgate.__main__ import main
from docgate.sources import pdf


def test_layout():
    assert pdf.wrap("") == [""] and pdf.wrap("ab cd", 3) == ["ab", "cd"] and pdf.wrap("甲乙丙", 4) == ["甲乙", "丙"]
    assert pdf.layout("# 一级\n\n正文\r\n") == [("一级", 1), ("", 0), ("正文", 0)]


def test_document():
    made = pdf.document("书", "\n\n".join("段" * 10 for _ in range(60)))
    start = int(re.search(rb"startxref\n(\d+)", made)[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", made[start:])]
    assert made[start : start + 4] == b"xref" and all(made[p:].startswith(b"%d 0 obj" % n) for n, p in enumerate(places, 1))
    assert made.count(b"/Type /Page ") == 3 and b"/Count 3" in made
    assert "段".encode("utf-16-be").hex().upper().encode() in made


def test_documents(spark):
    rows = spark.createDataFrame([(1, "甲\n" * 100), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.pages for r in pdf.documents(rows).collect()} == {1: 3, 2: 1}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# 卷一\n\n正文一句，到此为止，没有问题。\n")
    (tmp_path / "in" / "b.md").write_text("## 二级起\n")
    assert main(["run", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")]) == 1
    assert '"passed": 1' in capsys.readouterr().out
    assert main(["profiles"]) == 0
