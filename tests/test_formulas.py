from docgate.functions.dialect import over
from docgate.operators import formulas
from tests.test_engine import agree

#: text, what becomes of it, lines that went into others
CASES = [
    ("", "", 0),
    ("正文一句，到此为止。", "正文一句，到此为止。\n", 0),
    ("四物汤\n当归 川芎\n白芍 熟地\n", "四物汤 当归 川芎 白芍 熟地\n", 2),
    ("四物汤\n\n当归 川芎\n\n\n白芍 熟地\n\n正文一句。", "四物汤 当归 川芎 白芍 熟地\n\n正文一句。\n", 2),
    ("四物汤\n\n当归川芎\n", "四物汤\n\n当归川芎\n", 0),
    ("四物汤\n当归 川芎\n四君子汤\n人参 白术\n正文一句。", "四物汤 当归 川芎\n\n四君子汤 人参 白术\n\n正文一句。\n", 2),
    ("当归 川芎\n四物汤 白芍\n真武汤 茯苓", "当归川芎四物汤 白芍\n真武汤 茯苓\n", 2),  # no name first: cut only before a name inside
    ("组成 麻黄汤 桂枝甘草 白虎汤 石膏知母", "组成麻黄汤 桂枝 甘草\n白虎汤石膏 知母\n", 0),
    ("真武汤\n第一辑 茯苓 芍药\n# 下篇", "真武汤 茯苓 芍药\n# 下篇\n", 1),
    ("大补元煎 人参山药熟地", "大补元煎 人参 山药 熟地\n", 0),
    ("资生丸治疗脾虚", "资生丸治疗脾虚\n", 0),
    ("二陈汤\n半夏9g 陈皮6g\nSS号=12345", "二陈汤 半夏 9g 陈皮 6g\n\nSS号=12345\n", 1),
    ("some words here\nmore of them\nand, a stop.", "some words here more of them\n\nand, a stop.\n", 1),
    ("甲\n\n\n\n乙。", "甲\n\n乙。\n", 0),
    ("六味地黄丸 熟地黄山茱萸牡丹皮", "六味地黄丸 熟地 黄山茱\n萸牡丹 皮\n", 0),  # a kind's character within an ingredient counts
]


def test_examples(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.joins) for r in over(df, formulas.merged).collect()}
    for i, (text, want, n) in enumerate(CASES):
        assert got[i] == (want, n), text


def test_query_agrees_with_sql_written_separately(spark):
    agree(spark, "formulas_merged")


def test_lines_are_read_once(spark):
    df = spark.createDataFrame([(0, "四物汤\n当归 川芎\n"), (1, ""), (2, None), (None, "甲")], "doc_id long, text string")
    made = over(df, formulas.merged)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate posexplode") == 2, plan
    assert sorted(made.collect(), key=str) == sorted([(0, "四物汤 当归 川芎\n", 1), (1, "", 0), (2, None, 0), (None, "甲", 0)], key=str)
