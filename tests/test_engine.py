import pytest
from pyspark.sql import functions as F

from docgate.functions.dialect import DUCK, SPARK
from docgate.operators import clean, folds, gate
from docgate.plans import catalog, dirty

SF = "/root/testdata/sf0.001"


def agree(spark, name, sf=SF):
    """The query's rows are those of its SQL."""
    import duckdb

    got = catalog.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def gate_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in gate.gate(df).collect()}


CODES = {
    "empty_text": ["", "  \n", None],
    "zero_width_characters": ["# 标题\n\n文​本"],
    "replacement_characters": ["# 标题\n\n文�本"],
    "bad_control_characters": ["# 标题\n\n文\x07本"],
    "mojibake": ["# 标题\n\n锟斤拷"],
    "latex_artifacts": ["# 标题\n\n9\\mathrm{g}"],
    "abnormal_cjk_spaces": ["# 标题\n\n甲  乙"],
    "invalid_heading_syntax": ["#标题\n\n正文", "# 一\n\n####### 七级"],
    "nonstandard_heading_content": ["# ★★\n\n正文", "# 一\n\n## （12）", "# 一\n\n## 人参9g 白术6g"],
    "heading_level_jump": ["## 二级起", "# 一\n\n### 三"],
    "repeated_toc_heading_residue": ["# 目录\n\n- 一\n\n# 目 录"],
    "toc_page_heading_residue": ["# 目录\n\n## 总论 12", "# 书\n\n## 各论……12", "# 书\n\n## 余论／25"],
    "unstructured_front_matter_prefix": ["某某主编\n\n# 前言\n\n正文"],
    "duplicate_repeated_lines": ["# 一\n\n页脚文字\n\n页脚文字\n\n页脚文字"],
    "mega_line": ["# 一\n\n" + "字" * 3000],
    "headingless_long_document": ["字" * 2000 + "。"],
    "forced_line_breaks": ["# 一\n\n患者自述头痛已有三年之久每逢阴雨天气\n则疼痛加重而且伴有恶心呕吐等症状。", "# 一\n\n患者自述头痛已有三年之久每逢阴雨天气\n\n则疼痛加重而且伴有恶心呕吐等症状。"],
    "low_heading_density": ["# 一\n\n" + ("字" * 100 + "。\n\n") * 200],
}


def test_codes(spark):
    cases = [(code, t) for code, ts in CODES.items() for t in ts]
    got = gate_of(spark, *(t for _, t in cases))
    for i, (code, text) in enumerate(cases):
        assert code in got[i].errors, (code, text)
        assert got[i].accepted == (not got[i].blocking)


FINE = [
    "# 标题\n\n正文一句话，到此为止，没有别的问题。",
    "# 书名\n\n## 图 3\n\n见图。",
    "# 书名\n\n## 例 3 王某\n\n文。",
    "# 书名\n\n## 住院号 1165\n\n文。",
    "# 目录\n\n- 甲证 3……12\n\n# 前言\n\n# 甲证 3\n\n文。",
    "# 卷一\n\n熟地 归身 炙草 人参 肉桂\n茯苓 白术 甘草 陈皮 半夏\n",
    "# 卷一\n\n（1）\n\n（1）\n\n（1）\n",
]


def test_fine_texts_pass(spark):
    got = gate_of(spark, *FINE)
    assert {i: list(r.blocking) for i, r in got.items() if r.blocking} == {}


def test_clean(spark):
    texts = ["a​b�c\x07d\r\ne\rf", "<table><tr><td>甲</td><td>乙</td></tr></table>", "温度 $38^{\\circ}C$ 用 $9\\mathrm{g}$", "1901~1911年 就学", "x头部：百会", "a\n\n\n\n\n\nb  \n", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in clean.clean(df).collect()}
    assert got[0] == "abcd\ne\nf\n" and got[1] == "| 甲 | 乙 |\n" and "38℃" in got[2] and "$" not in got[2] and "9g" in got[2]
    assert got[3] == "- 1901~1911年 就学\n" and got[4] == "x\n头部：百会\n" and got[5] == "a\n\nb\n" and got[6] == got[7] == ""
    again = {r.doc_id: r.text for r in clean.clean(spark.createDataFrame(list(got.items()), "doc_id long, text string")).collect()}
    assert again == got
    changes = clean.rule_changes(df).filter("doc_id = 0").select("rule_id").collect()
    assert [r.rule_id for r in changes][:4] == ["artifact.zero_width_remove", "artifact.replacement_char_remove", "artifact.bad_control_remove", "line_endings.normalize"]


def test_folds():
    assert folds.normalize_tables(["| a | b |", "| 1 | 2 |", "", "| 3 | 4 |", "t"]) == ["| a | b |", "|---|---|", "| 1 | 2 |", "| 3 | 4 |", "t"]
    assert folds.normalize_tables(["| a | b", "c |", "| 1 | |", "| 2 |"]) == ["| a | b c |", "|---|---|", "| 1 | 2 |"]
    joined = folds.soft_join(["患者自述头痛已有三年之久每逢阴雨天气", "", "", "则疼痛加重而且伴有恶心呕吐等症状。"])
    assert joined[0] == "患者自述头痛已有三年之久每逢阴雨天气则疼痛加重而且伴有恶心呕吐等症状。"
    assert folds.soft_join(["# 标题很长很长很长很长很长很长", "正文从这里开始一直写下去"]) == ["# 标题很长很长很长很长很长很长", "正文从这里开始一直写下去"]
    long = "字" * 2000 + "。" + "文" * 2000
    assert [len(x) for x in folds.split_overlong([long])] == [2001, 2000]
    assert folds.chunks("") == [] and folds.chunks("a\n\nb") == ["a\n\nb"]
    code = "```\n" + "x\n\n" * 1500 + "```"
    made = folds.chunks("p\n\n" + code + "\n\nq")
    assert made == ["p", code, "q"]
    text = "\n\n".join("段" * 300 for _ in range(20))
    assert "\n\n".join(folds.chunks(text)) == text and max(map(len, folds.chunks(text))) <= 2000


def test_tables_of_contents():
    from docgate.operators.finalize import tidy_contents

    got = tidy_contents(["# 目录", "## 总论 (1)", "各论……12", "万里云大万里路", "——自传 (30)", "", "# 前言", "正文。", "# 目 录", "一、全身证状"])
    assert got == ["# 目录", "- 总论 (1)", "- 各论……12", "- 万里云大万里路——自传 (30)", "", "# 前言", "正文。", "一、全身证状"]
    assert tidy_contents(got) == got
    bare = tidy_contents(["书", "甲 (1)", "乙 (2)", "丙 (3)", "这里是正文"])
    assert bare == ["书", "# 目录", "- 甲 (1)", "- 乙 (2)", "- 丙 (3)", "这里是正文"]
    assert tidy_contents(["甲 (1)", "正文"]) == ["甲 (1)", "正文"] and tidy_contents([]) == []


def test_fold_and_plan_find_the_same_units(spark):
    sql = dirty.view(SPARK)
    spark.read.parquet(f"{SF}/documents.parquet").createOrReplaceTempView("documents")
    texts = {r.doc_id: r.text for r in spark.sql(sql).collect()}
    got = catalog.run("chunk_units")(spark, SF).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    fine = [i for i, t in texts.items() if "\r" not in t]
    counts = {r.doc_id: r.n for r in got}
    assert all(counts.get(i, 0) == len(folds.units(texts[i])) for i in fine)


@pytest.mark.parametrize(
    ("build", "step"),
    [("without_echo", "drop_echo"), ("without_prefix", "drop_prefix"), ("without_titles", "drop_titles"), ("without_short_repeats", "drop_short_repeats"), ("relevelled", "cap_levels")],
)
def test_windows_and_functions_agree(spark, build, step):
    from docgate.operators import finalize, structure

    extra = ["# 前言\n\n前\n言\n目\n\n前", "# 甲乙\n甲\n\n乙", "甲\n# 书名\n## 书名\n# 书名\n```\n# 不是\n```\n#### 深", "短短短\n\n短短短\n\n\n短短短\n末", "", "\n\n"]
    spark.read.parquet(f"{SF}/documents.parquet").createOrReplaceTempView("documents")
    texts = {r.doc_id: r.text for r in spark.sql(dirty.view(SPARK)).collect() if "\r" not in r.text} | {10_000 + i: t for i, t in enumerate(extra)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").createOrReplaceTempView("lines_input")
    sql = structure.packed(SPARK, getattr(structure, build)(SPARK, "lines_input"))
    got = {r.doc_id: r.text for r in spark.sql(sql).collect()}
    want = {i: "\n".join(getattr(finalize, step)(t.split("\n"))) for i, t in texts.items()}
    assert {i: got.get(i, "") for i in texts} == want


@pytest.mark.parametrize("name", ["gate_acceptance", "clean_text", "running_headers_removed", "heading_level_cap", "latest_state", "breaker_open_intervals"])
def test_against_sql(spark, name):
    agree(spark, name)


def test_sources(spark, tmp_path):
    from docgate.sources import files

    for name, data in (("10 b.md", b"ok \xff"), ("2 a.md", "甲".encode()), ("x.pdf", b"%"), ("skip.exe", b""), ("c.DOCX", b"PK")):
        (tmp_path / name).write_bytes(data)
    found = files.discover(spark, str(tmp_path)).collect()
    assert [(r.name, r.kind) for r in found] == [("2 a.md", "markdown"), ("10 b.md", "markdown"), ("c.DOCX", "word"), ("x.pdf", "pdf")]
    assert sorted(r.text for r in files.texts(spark, str(tmp_path)).collect()) == ["ok �", "甲"]
    gated = gate.gate(spark.createDataFrame([(1, "# 卷一\n\n文。"), (2, "#坏")], "doc_id long, text string"))
    files.deliver(gated, f"{tmp_path}/out")
    back = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert back[1].status == "passed" and back[1].text and back[2].text is None and back[2].blocking == "invalid_heading_syntax"
    (tmp_path / "log.json").write_text('{"stage": "review", "call_index": 1}\nnot json\n')
    assert files.log(spark, f"{tmp_path}/log.json").count() == 1


def test_streams(spark, tmp_path):
    from docgate.streaming import state

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = state.events(spark, f"{tmp_path}/in", files=1)
    for name, df, mode in (("latest", state.latest_state(stream), "complete"), ("hours", state.hourly_counts(stream), "complete")):
        df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    want = {(r.entity, r.event_id, r.status) for r in catalog.run("latest_state")(spark, SF).collect()}
    assert {(r.entity, r.event_id, r.status) for r in spark.table("latest").collect()} == want
    assert spark.table("hours").agg(F.sum("calls")).first()[0] == events.count()
    import datetime

    start = datetime.datetime(2024, 1, 1)
    seen = [(0, 9), (1, 9), (2, 0), (3, 9), (4, 9), (5, 9), (6, 0), (66, 9), (67, 0), (130, 0), (131, 9), (132, 9), (133, 9)]  # second, value
    rows = [(i, start + datetime.timedelta(seconds=s), 1, "call", float(v), "{}") for i, (s, v) in enumerate(seen)]
    spark.createDataFrame(rows, state.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = state.breaker(state.events(spark, f"{tmp_path}/one"), failed_above=1.5, opens_at=3)
    one.writeStream.outputMode("append").format("memory").queryName("breaker").trigger(availableNow=True).start().awaitTermination()
    assert [(r.event_id, r.state) for r in spark.table("breaker").orderBy("event_id").collect()] == [(5, "open"), (7, "half_open"), (7, "open"), (9, "half_open"), (9, "closed"), (12, "open")]


def test_upserts_keep_one_row_of_each_entity(spark, tmp_path):
    from docgate.streaming import state

    events = spark.read.parquet(f"{SF}/events.parquet")
    assert state.read_latest(spark, f"{tmp_path}/table") is None
    for k, part in enumerate(events.randomSplit([0.5, 0.5], seed=3)):
        part.coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        state.upsert_latest(state.events(spark, f"{tmp_path}/in", files=1), f"{tmp_path}/table", f"{tmp_path}/check").awaitTermination()
        now = state.read_latest(spark, f"{tmp_path}/table")
        assert now.count() == now.select("entity").distinct().count()
    want = {(r.entity, r.event_id, r.status) for r in catalog.run("latest_state")(spark, SF).collect()}
    assert {(r.entity, r.event_id, r.status) for r in now.collect()} == want


def test_commands(spark, tmp_path, capsys):
    import json

    from docgate.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1 书.md").write_text("# 卷一\n\n文一句，到此为止。\n")
    (tmp_path / "in" / "2 坏.md").write_text("# 卷\n\nÃ\n")
    for name in ("profiles", "rules", "codes", "queries"):
        assert main([name]) == 0
    capsys.readouterr()
    assert main(["inspect", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out"]) == 0
    assert [json.loads(x)["name"] for x in capsys.readouterr().out.splitlines()] == ["1 书.md", "2 坏.md"]
    assert main(["run", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out"]) == 1
    assert json.loads(capsys.readouterr().out)["status"] == {"passed": 1, "needs_revision": 1}
    assert main(["batch", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/two", "--manifest", f"{tmp_path}/out"]) == 1
    assert json.loads(capsys.readouterr().out)["status"] == {"needs_revision": 1}
    for name in ("chunks", "pdf", "clean"):
        assert main([name, "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/{name}"]) == 0
    assert main(["gate", "--input", f"{tmp_path}/in"]) == 0
    (tmp_path / "log.json").write_text('{"stage": "review", "status": "ok", "estimated_cost": 0.5}\n{"stage": "review", "status": "error"}\n')
    capsys.readouterr()
    assert main(["cost-report", "--log", f"{tmp_path}/log.json"]) == 0
    assert json.loads(capsys.readouterr().out) == {"stage": "review", "calls": 2, "failed": 1, "seconds": None, "cost": 0.5}
