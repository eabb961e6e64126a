import io
import json
import os
import zipfile

import pytest

from docgate.sources import acquire, locks

PDF = b"%PDF-1.4 /Type /Pages /Count 3 /Type /Page x /Type /Page y /Type/Page z"


def archive(name):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/other.md", "no")
        z.writestr(name, "# 题\n文")
    return out.getvalue()


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content binary")


def test_pages_and_splits(spark):
    df = files(spark, ("a.pdf", PDF), ("b.pdf", b"junk"), ("c.pdf", None))
    assert {r.path: r.pages for r in acquire.pages(df).collect()} == {"a.pdf": 3, "b.pdf": None, "c.pdf": None}
    assert {r.path: r.pages for r in acquire.pages(df, fallback=len).collect()} == {"a.pdf": 3, "b.pdf": 4, "c.pdf": 0}
    got = acquire.split(df, lambda content, a, b: f"{a}-{b}".encode(), most=2).collect()
    assert [(r.segment, r.first_page, r.last_page, bytes(r.content)) for r in got if r.path == "a.pdf"] == [(1, 1, 2, b"1-2"), (2, 3, 3, b"3-3")]
    assert {r.path for r in got if r.error} == {"b.pdf", "c.pdf"}


def test_conversion_and_archives(spark):
    df = files(spark, ("a.docx", b"a"), ("b.docx", b"b"))

    def convert(content):
        if content == b"a":
            raise ValueError("not again")
        return content * 2

    cache = spark.createDataFrame([("a.docx", b"cached"), ("z.docx", b"other")], "path string, made binary")
    assert {r.path: (bytes(r.made), r.error) for r in acquire.converted(df, convert, cache).collect()} == {"a.docx": (b"cached", None), "b.docx": (b"bb", None)}
    assert {r.path: r.error for r in acquire.converted(df, convert).collect()} == {"a.docx": "not again", "b.docx": None}
    got = acquire.unzipped(files(spark, ("a.zip", archive("x/full.md")), ("b.zip", archive("x/part.md")), ("c.zip", b"?"))).collect()
    assert {r.path: r.text for r in got} == {"a.zip": "# 题\n文", "b.zip": None, "c.zip": None}


class Remote:
    def recognise(self, items):
        assert len(items) <= 3
        if any(content == b"bad" for _, content in items):
            raise RuntimeError("down")
        return {i: f" {content.decode()} \n" for i, content in items if content != b"lost"}


def test_recognition_in_batches(spark):
    rows = [("/x/书 一.pdf", k, f"s{k}".encode()) for k in range(1, 8)] + [("/x/b.pdf", 1, b"lost")]
    df = spark.createDataFrame(rows, "path string, segment int, content binary").coalesce(1)
    first = acquire.recognised(df, Remote(), size=3, pause=0.0)
    got = {(r.path, r.segment): r for r in first.collect()}
    assert len(got) == 8 and got["/x/书 一.pdf", 7].text == " s7 \n" and got["/x/b.pdf", 1].error == "no result"
    assert got["/x/书 一.pdf", 2].data_id == "docgate_书_一_002"
    done = first.filter("error is null").select("data_id", "text")

    class Nothing:
        def recognise(self, items):
            assert {c for _, c in items} == {b"lost"}
            return {i: "found" for i, _ in items}

    again = acquire.recognised(df, Nothing(), done, pause=0.0)
    whole = {r.path: (r.text, r.complete) for r in acquire.merged(again).collect()}
    assert whole == {"/x/书 一.pdf": ("\n\n".join(f"s{k}" for k in range(1, 8)), True), "/x/b.pdf": ("found", True)}
    assert {r.error for r in acquire.recognised(spark.createDataFrame([("p.pdf", 1, b"bad")], df.schema), Remote(), pause=0.0).collect()} == {"down"}


def test_retries():
    calls = []

    class Later(Exception):
        status = 503

    class Never(Exception):
        status = 400

    def fails(error, times):
        def do():
            calls.append(1)
            if len(calls) <= times:
                raise error
            return {"x": "y"}

        return do

    waits = []
    assert acquire.with_retries(fails(Later(), 2), sleep=waits.append) == {"x": "y"} and waits == [1.0, 2.0]
    calls.clear()
    with pytest.raises(Never):
        acquire.with_retries(fails(Never(), 1), sleep=waits.append)
    assert len(calls) == 1


def test_largest(spark):
    df = spark.createDataFrame([("a", "1.md", "xx"), ("a", "2.md", "xxx"), ("a", "3.md", "yyy"), ("b", "1.md", None)], "path string, output string, text string")
    assert {(r.path, r.output) for r in acquire.largest(df).collect()} == {("a", "2.md"), ("b", "1.md")}


def test_run_locks(tmp_path):
    lock = locks.acquire(tmp_path, "one")
    with pytest.raises(locks.Active, match="one"):
        locks.acquire(tmp_path, "two")
    lock.beat("gate")
    lock.release("finished")
    second = locks.acquire(tmp_path, "two")
    lock.beat("late")  # no longer its own
    assert json.loads(second.path.read_text())["run_id"] == "two" and (tmp_path / "docgate_run.lock.stale.json").exists() or second.path.with_suffix(".stale.json").exists()
    assert locks.stale({"status": "running", "pid": 2**22 + 1}, 60) and not locks.stale({"status": "running", "pid": os.getpid()}, 60)
    assert locks.stale({"status": "running", "updated_at": "2020-01-01T00:00:00+00:00"}, 60) and not locks.stale({}, 60)
