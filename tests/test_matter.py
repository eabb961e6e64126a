from docgate.functions.dialect import SPARK
from docgate.operators import matter, structure

THEOREM = "Theorem 1.2. Let F(x) be a polynomial over a finite field and P a prime ideal with x \\in P, so the claim holds."
BODY = "\n".join(f"第{i}段正文，写得不短，说明病情。" for i in range(12))
LONG, REST = (BODY + "\n") * 6, "长正文一行，没有什么字段。\n" * 45
NAMES = "王某某李某某" * 10

#: operator, text, what becomes of it (None: nothing)
CASES = [
    ("cover_prefix_removed", "临中\n家\n医\n# 目录\n文", "# 目录\n文"),
    ("cover_prefix_removed", "一段文字，讲清楚了。\n# 目录\n文", None),
    ("caption_noise_removed", "# 前言\n![图](a.png)\n某某教授\n乱字\n\n# 12\n# 自序\n文", "# 前言\n![图](a.png)\n某某教授\n\n# 自序\n文"),
    ("theorems_removed", f"甲\n\n{THEOREM}\n\n{THEOREM}\n\n乙", "甲\n乙"),
    ("theorems_removed", "甲\n\nTheorem 1. short\n\n乙", None),
    ("front_matter_cut", "ISBN 7-117\n开本：850\n# 内容提要\n文", "# 内容提要\n文"),
    ("front_matter_cut", "# 第一章\n很长的正文。\n# 前言\n文", None),
    ("front_matter_cut", "这里先有一段很长的正文，一直写到六十个字以上，说的是病情与治法，句子之间有停顿，也有结尾，决不是书前的题名与版权，所以应当留下来不动才对，请勿删去，再添几句凑足八十个字，以免被当作短行。\n# 第一章 总论\n文", None),
    ("inner_title_page_removed", "# 出版说明\n话。\n# 中国百年百名中医临床家丛书\n某某主编\n# 内容提要\n文", "# 出版说明\n话。\n# 内容提要\n文"),
    ("front_catalogue_removed", f"# 中国百年百名中医临床家丛书\n（按姓氏笔画排列）\n{NAMES * 3}\n# 目录\n- 一 1", "# 目录\n- 一 1"),
    ("front_imprint_removed", "# 内容提要\n文。\n出版发行：某社 印刷：某厂 开本：850毫米\n# 目录\n\n- ISBN 7-117-0\n- 总论 3", "# 内容提要\n文。\n# 目录\n- 总论 3"),
    ("trailing_imprint_cut", f"{BODY}\n\n# 图书在版编目（CIP）数据\nISBN 7\n定价：12.00元\n某出版社\n开本：850\n![a](b.png)", BODY),
    ("trailing_imprint_cut", f"{BODY}\n\n# 图书在版编目（CIP）数据\nISBN 7\n文字。", None),
    ("trailing_catalogue_cut", f"{BODY}\n\n# 中国百年百名中医临床家丛书（按姓氏笔画排列）\n{NAMES}", BODY),
    ("trailing_catalogue_cut", f"{BODY}\n\n# 中国百年百名中医临床家丛书（按姓氏笔画排列）\n{NAMES}\n# 目录", None),
    ("trailing_outline_cut", f"{BODY}\n版权页\n前言\n目录\n正文", BODY),
    ("trailing_outline_cut", f"{BODY}\n版权页\n前言\n正文", None),
    # the first place doesn't qualify, a later one does
    ("inner_title_page_removed", "# 出版说明\n话。\n# 中国百年百名中医临床家丛书\n一句正文，不是题名页。\n# 内容提要\n文。\n# 中国百年百名中医临床家丛书\n某某主编\n# 目录\n文", "# 出版说明\n话。\n# 中国百年百名中医临床家丛书\n一句正文，不是题名页。\n# 内容提要\n文。\n# 目录\n文"),
    ("front_catalogue_removed", f"# 中国百年百名中医临床家丛书\n文。\n# 目录\n- 一 1\n# 中国百年百名中医临床家丛书\n（按姓氏笔画排列）\n{NAMES * 3}\n# 目录\n- 二 2", "# 中国百年百名中医临床家丛书\n文。\n# 目录\n- 一 1\n# 目录\n- 二 2"),
    ("trailing_imprint_cut", f"{LONG}# 图书在版编目（CIP）数据\n{REST}# 图书在版编目（CIP）数据\nISBN 7\n定价：12.00元\n某出版社\n开本：850\n![a](b.png)", f"{LONG}# 图书在版编目（CIP）数据\n{REST}".rstrip("\n")),
    ("trailing_catalogue_cut", f"{BODY}\n# 中国百年百名中医临床家丛书（按姓氏笔画排列）\n文。\n# 目录\n{BODY}\n# 中国百年百名中医临床家丛书（按姓氏笔画排列）\n{NAMES}", f"{BODY}\n# 中国百年百名中医临床家丛书（按姓氏笔画排列）\n文。\n# 目录\n{BODY}"),
    ("trailing_outline_cut", f"{BODY}\n版权页\n这里还有一段话。\n版权页\n前言\n目录\n正文" + "\n" * 9, f"{BODY}\n版权页\n这里还有一段话。"),
    ("second_contents_cut", f"# 目录\n- 一 1\n{BODY}\n# 目录\n# 医家小传\n# 专病论治\n# 甲证\n# 乙证\n# 丙证", f"# 目录\n- 一 1\n{BODY}"),
    ("trailing_cut", "# 书\n文。\n# 临中床医\n![x](y.jpg)\n定价：9元\n\n", "# 书\n文。"),
    ("trailing_cut", "# 书\n文。\n![x](y.jpg)\n\n", None),
    ("trailing_cut", "", None),
    ("trailing_cut", "# 临中\n\n", ""),
    ("heading_levels_standard", "#前言\n# ※※\n# （3）\n## 丙 3g 丁 4g\n一、总论\n1. 分论\n案1 某\n#### 深\n####\n# # 嵌套", "# 前言\n（3）\n丙 3g 丁 4g\n## 一、总论\n### 1. 分论\n### 案1 某\n# 嵌套"),
    ("heading_levels_standard", "## 起始\n##### 一个很长的不像标题的标题，带着逗号一直写到二十八个字以上才算完。", "## 起始\n### 一个很长的不像标题的标题，带着逗号一直写到二十八个字以上才算完。"),
    ("heading_levels_standard", "```\n# 不动\n```", None),
    ("first_heading_top", "文\n### 一\n## 二", "文\n# 一\n## 二"),
]


def test_examples(spark):
    for name in {n for n, *_ in CASES}:
        own = [(i, t, w) for i, (n, t, w) in enumerate(CASES) if n == name]
        spark.createDataFrame([(i, t) for i, t, _ in own], "doc_id long, text string").createOrReplaceTempView("matter_cases")
        made = structure.packed(SPARK, matter.MATTER[name](SPARK, structure.rows(SPARK, "matter_cases")))
        got = {r.doc_id: r.text for r in spark.sql(made).collect()}
        for i, text, want in own:
            assert got[i] == (text if want is None else want), (name, text)


def test_a_chain_keeps_every_document(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)] + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in matter.apply(df, *matter.MATTER).collect()}
    assert len(got) == len(CASES) + 1 and got[99] == ""


def test_a_chain_keeps_one_order(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "doc_id long, text string")
    made = matter.apply(df, "cover_prefix_removed", "front_matter_cut", "trailing_outline_cut", "trailing_cut")
    plan = made._jdf.queryExecution().sparkPlan().toString(), made._jdf.queryExecution().executedPlan().toString()
    assert plan[1].count("Sort [") == 1, plan[1]
    # a frame of all that follows takes Spark the square of a document's lines
    assert "UNBOUNDED FOLLOWING" not in matter.without_caption_noise(SPARK, "lines")
