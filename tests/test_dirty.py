import re

from docgate.functions.dialect import DUCK
from docgate.plans import catalog, dirty

SF = "/root/testdata/sf0.001"
ADDED = re.compile("[\r\x07​]")


def test_folded_queries_read_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in catalog._dirty(spark, SF).collect()}
    assert got.pop(dirty.EMPTY_ID) == "" and got.keys() == texts.keys()
    assert all(ADDED.sub("", texts[i]) in ADDED.sub("", t) for i, t in got.items())


def test_view_is_the_same_in_both_engines(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert dict(con.execute(f"SELECT doc_id, text FROM ({dirty.view(DUCK)})").fetchall()) == {r.doc_id: r.text for r in catalog._dirty(spark, SF).collect()}
