import pytest

from docgate.functions.dialect import over
from docgate.operators import index

#: text, what its index becomes (None: nothing), entries
CASES = [
    ("无", None, 0),
    ("引文 索引\n二画\n甲 1", None, 0),
    ("索引", "# 索引\n", 0),
    ("正文\n# 索引\n二画\n- - 七日风 74\n子晕 242\n", "正文\n# 索引\n\n## 二画\n\n- 七日风 74\n- 子晕 242\n", 2),
    ("# 索引\n三 画子悬 240\n十九画癣疮 11\n", "# 索引\n\n## 三画\n\n- 子悬 240\n\n## 十九画\n\n- 癣疮 11\n", 2),
    ("# 索引\n（参见 12）\n\n甲 证 5\n参见 9 乙证 6\n丙 7", "# 索引\n\n- 甲证（参见 12） 5\n- 乙证（参见 9） 6\n- 丙 7\n", 3),
    ("# 索引\n参见 5\n参见 6\n丁 7\n戊 8", "# 索引\n\n- 丁（参见 6） 7\n- 戊 8\n", 2),
    ("# 索引\n二画\n甲 1\n二画\n乙 2\n三画丙 3", "# 索引\n\n## 二画\n\n- 甲 1\n- 乙 2\n\n## 三画\n\n- 丙 3\n", 3),
    ("# 索引\n中医临证备要\n第一辑\n乱 字\n甲 1\n# 索引\n乙 2", "# 索引\n\n- 甲 1\n", 1),
    ("# 索引\n四画\n五画\n参见 3", "# 索引\n\n## 四画\n\n## 五画\n", 0),
    ("# 索引\n-四画戊 4\n参见7 二画己 5\n- 参见 8\n一画\n庚 6", "# 索引\n\n## 四画\n\n- 戊 4\n\n## 二画\n\n- 己（参见 7） 5\n\n## 一画\n\n- 庚（参见 8） 6\n", 3),
    ("## 索引 \n甲·  0012", "# 索引\n\n- 甲 0012\n", 1),
]


def test_examples(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.entries) for r in over(df, index.normalised).collect()}
    assert got == {i: (t if want is None else want, n) for i, (t, want, n) in enumerate(CASES)}


def test_again_changes_nothing_but_notes(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES) if t and "参见" not in t], "doc_id long, text string")
    assert {r.doc_id: r.text for r in over(df, index.normalised).collect()} == {r.doc_id: r.text for r in df.collect()}


@pytest.mark.parametrize("name", ["index_normalised"])
def test_query_agrees_with_sql_written_separately(spark, name):
    from tests.test_engine import agree

    agree(spark, name)
