"""What Spark does in place of a costly pattern gives what the pattern gives."""

from docgate.functions import text as t
from docgate.functions.dialect import DUCK, SPARK
from docgate.functions.lexicon import SPACE
from docgate.operators import clean, matter

ODD = [
    "", " ", "\t\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　", "a", "  a  b ", "　a  b\x1f", "a\n", "a \n b\r\n", " \n\n ", "x  y\tz", " a ", "​a​", "a\x00 ", "中 文　",
    "isbn 7", "ISBN 7-117", "See cip", "x/r.1", "WWW.pmph.com", "e - mail: x", "People's Medical Publishing", "http://x", "R 12", "r12", "Short", "Not so short a line", "目录", "前言 (3)", "# 目录", "(12)", "Chapter 12", "Chapter (12)", "x....12", "第 12", "见 12", "some long title; with [brackets] (12)",
    "附录：凡 例", "出版社 编", "| 甲某 | 乙某 |", "|a|b|", "1. x", "�", "12）",
]


def test_both_engines_agree_on_odd_lines(spark):
    import duckdb

    def made(d):
        x = "x"
        bools = [t.is_major(d, x), t.is_page_entry(d, t.squeeze(d, x)), t.is_reliable_front(d, x), matter.is_metadata(d, x), matter.is_title_page(d, x), matter.is_imprint(d, x), matter.is_name_row(d, x), matter.is_entry(d, x)]
        texts = [t.strip(d, x), t.squeeze(d, x), t.heading_text(d, x), clean._line_ends(d, x), clean._blank(d, x), d.strip(x, SPACE, (r"\A", r"\z"))]
        return ", ".join(f"{e} AS c{k}" for k, e in enumerate(bools + texts))

    spark.createDataFrame(list(enumerate(ODD)), "i long, x string").createOrReplaceTempView("odd_lines")
    got = [tuple(r) for r in spark.sql(f"SELECT i, {made(SPARK)} FROM odd_lines ORDER BY i").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE odd_lines (i BIGINT, x VARCHAR)")
    con.executemany("INSERT INTO odd_lines VALUES (?, ?)", list(enumerate(ODD)))
    want = con.execute(f"SELECT i, {made(DUCK)} FROM odd_lines ORDER BY i").fetchall()
    for g, w in zip(got, want, strict=True):
        assert g == w, ODD[g[0]]


def test_ends_are_stripped_without_a_pattern():
    assert "regexp" not in t.strip(SPARK, "x") and "regexp" not in clean._line_ends(SPARK, "x")


def test_folds_get_small_batches(spark):
    from docgate.operators import folds

    df = spark.createDataFrame([(i, "x\n") for i in range(5000)], "doc_id long, text string").coalesce(1)
    made = folds.apply(df, "split_overlong")
    assert made.count() == 5000 and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
