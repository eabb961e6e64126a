import pytest

from docgate.functions.dialect import DUCK, over
from docgate.operators import recognised
from tests.test_engine import agree

CHART = '<details><summary>flowchart</summary>\ngraph TD\nA["甲"] --> B["乙"]\nA["甲"] --> B["乙"];\nA --> C\nD(丙|丁 - 注) --> E 戊\n</details>\n尾'
TABLE = "表格结构转写（由 MinerU flowchart 提取）\n\n| 项目 | 内容 |\n|---|---|\n| 甲 | 乙 |\n| 丙｜丁 | 戊 |"
THEOREM = "Theorem 2.1. Let F(x) be a polynomial over a finite field with q elements and so on"
PLAIN = "Theorem 2.1. This is about nothing of the kind and goes on for more than forty signs"
CASES = [
    ("clean_temperature", "体温39%，汗出。有效率39%", "体温39℃，汗出。有效率39%"),
    ("clean_temperature", "发热38.5%~ 39%～40 %，占40%，40%的，41%患者，46%", "发热38.5℃~39℃~40℃，占40%，40℃的，41%患者，46%"),
    ("clean_temperature", "脉数39%；体温 138%", "脉数39%；体温 138℃"),
    ("clean_flowcharts", "表 1 略\n\n" + CHART, "表 1 略\n\n" + TABLE + "\n\n尾"),
    ("clean_flowcharts", "![表](a.png)\n" + CHART, "![表](a.png)\n\n" + TABLE + "\n\n尾"),
    ("clean_flowcharts", "无关\n\n" + CHART, "无关\n\n尾"),
    ("clean_flowcharts", "表 1\n" + "长" * 600 + CHART + CHART, "表 1\n" + "长" * 600 + "\n\n尾\n\n尾"),
    ("clean_foreign_math", f"前\n{THEOREM}\n后", "前\n\n后"),
    ("clean_foreign_math", PLAIN, PLAIN),
    ("clean_foreign_math", "甲\n1. \\therefore m = -1胎前\n乙\\therefore m - 1 \\neq 2;丙\\therefore 丁\n\n\n\n\n戊", "甲\n\n胎前\n乙 丙∴ 丁\n\n\n戊"),
    ("clean_bibliography", "References: Smith 1999 Jones A 2001 Doe", "References: Smith\n1999\nJones A\n2001\nDoe"),
    ("clean_bibliography", "xReferences: Smith 1999 Jones", "xReferences: Smith 1999 Jones"),
]


def test_examples_in_both_engines(spark):
    import duckdb

    df = spark.createDataFrame([(i, n, t) for i, (n, t, _) in enumerate(CASES)], "doc_id long, name string, text string")
    con = duckdb.connect()
    for name, rule in recognised.RECOGNISED.items():
        want = {i: w for i, (n, _, w) in enumerate(CASES) if n == name}
        got = over(df.filter(df.name == name), lambda d, x, rule=rule: f"SELECT doc_id, {rule(d, 'text')} AS made FROM {x}").collect()
        assert {r.doc_id: r.made for r in got} == want
        con.execute("CREATE OR REPLACE TABLE t (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(i, t) for i, (n, t, _) in enumerate(CASES) if n == name])
        assert dict(con.execute(f"SELECT doc_id, {rule(DUCK, 'text')} FROM t").fetchall()) == want


@pytest.mark.parametrize("name", [*recognised.RECOGNISED])
def test_queries_agree_with_their_sql(spark, name):
    agree(spark, name)


def test_wrappers_go_on_every_level(spark):
    import duckdb

    from docgate.operators import clean

    deep = "用量 " + "\\mathrm{\\text{" * 4 + "黄芪" + "}}" * 4 + " 一两\\mathrm{" + "长" * 1199 + "} \\text{" + "长" * 1201 + "}"
    want = "用量 黄芪 一两" + "长" * 1199 + " \\text{" + "长" * 1201 + "}"
    df = spark.createDataFrame([(deep,)], "text string")
    assert over(df, lambda d, x: f"SELECT {clean.unit_math(d, 'text')} AS made FROM {x}").first().made == want
    con = duckdb.connect()
    con.execute("CREATE TABLE t (text VARCHAR)")
    con.execute("INSERT INTO t VALUES (?)", [deep])
    assert con.execute(f"SELECT {clean.unit_math(DUCK, 'text')} FROM t").fetchone()[0] == want
