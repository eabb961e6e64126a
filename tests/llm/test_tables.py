import base64
import hashlib
from collections import Counter

import numpy as np
import pytest


def test_embeddings(spark):
    from docgate.llm.embeddings import dedup

    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    vectors = [*base.tolist(), *(base[:20] + 0.02 * rng.standard_normal((20, 16))).tolist(), *(3 * base[:5]).tolist(), *base[:3].tolist()]
    vectors += [(base[7] + 0.05 * rng.standard_normal(16)).tolist() for _ in range(40)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None], [float("inf"), 1.0], [1.0, 2.0]]
    rows = [(i, v, "l", 3) for i, v in enumerate(vectors + bad)] + [(None, base[9].tolist(), None, None), (2, base[2].tolist(), None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, node int")
    good = [(i, np.array(v)) for i, v, *_ in rows if v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= 0.95
    group = np.arange(len(good))
    for _ in range(len(good)):
        group = np.array([group[n].min() for n in near])
    least = [min((good[j][0] for j in np.flatnonzero(group == g) if good[j][0] is not None), default=None) for g in group]
    want = Counter((i, int(n.sum()) - 1, c, i == c) for (i, _), n, c in zip(good, near, least, strict=True))
    want += Counter((i, 0, i, True) for i, v, *_ in rows if not (v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)))
    for most in (2048, 4):
        assert Counter(tuple(r) for r in dedup(df, most=most).collect()) == want
    assert dedup(df.limit(0)).count() == 0


def test_warc(spark):
    from docgate.llm.warc import read, write

    pages = [(1, "http://a/1", "x"), (2, "http://a/ü 2\r\n", "x"), (3, None, "é" * 3000), (4, "u", None), (5, "u", ""), (None, "u", "x"), (6, "u", "HTTP/1.1\r\n\r\nWARC/1.1"), (7, "u", "y"), (7, "u", "y")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    index = write(df)
    got = read(index).collect()
    want = Counter()
    for i, _, html in pages:
        payload = (html or "").encode()
        top = max((p[0] for p in pages if (p[2] or "") == (html or "") and p[0] is not None), default=None)
        want[(i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if i == top else "revisit", None if i == top else top)] += 1
    twice = next(k for k in want if k[0] == 7)
    want[twice] -= 1
    want[(*twice[:3], "revisit", 7)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    html = {p[0]: (p[2] or "").encode() for p in pages}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response")
    some = read(index.filter("page_id = 3"), gap=0).collect()
    assert [bytes(r.payload) for r in some] == [html[3]]
    assert read(write(df, least=2)).filter("record_type = 'revisit'").count() == 0
    assert read(write(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["op1_embedding_neardedup", "op3_exact_dedup", "op4_warc_index", "op6_secret_ledger", "op7_fair_mix", "op8_substring_dedup"])
def test_against_sql(spark, name):
    import duckdb

    from docgate.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_pipeline(spark):
    import corpus_pipeline
    from docgate.llm.common import table, written

    docs = first = table(spark, "/root/testdata/sf0.001", "documents")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == first.columns
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
        if name == "exact dedup":
            assert docs.selectExpr("lower(text) AS t").distinct().count() <= docs.count()
    mix = before.groupBy("doc_id").count().collect()
    starts = docs.filter("start = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in starts} == {r.doc_id: r["count"] for r in mix}
