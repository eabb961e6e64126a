"""What the structure pass and the gate leave out of the work changes no result."""

import pyarrow as pa
from pyspark.sql import functions as F

from docgate.functions.dialect import SPARK
from docgate.functions.lexicon import BLOCKING, CJK, GATE_PUNCTUATION, READABLE, SCORE_PUNCTUATION
from docgate.operators import finalize, gate, matter
from docgate.plans import catalog
from tests.test_cheap import ODD
from tests.test_engine import CODES, SF
from tests.test_matter import CASES

SIGNS = ["ISBN 7-117-1", "定 价：3元", "/王某编 出版社", "毫米 印数", "People's Medical Publishing", "版 次：1", "E - mail : x", "三河市某印刷厂", "书／甲著。R · 2", "定价3元"]


def test_input_is_read_once(spark):
    """The lines of a step and what it is compared with each ran all that came before, twice as often with each step."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)

    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "doc_id long, text string")
    made = finalize.finalize(df.mapInArrow(counted, df.schema)).collect()
    assert len(made) == len(CASES) and seen.value == len(CASES)


def test_texts_skip_only_what_cannot_change_them(spark):
    lines = [*ODD, *SIGNS]
    texts = [t for _, t, _ in CASES] + [f"{a}\n{b}\n# 一\n\n{a}" for a in lines for b in (lines[0], lines[-1])] + ["# 一\n文", "文", "  # 一\n \t# 二", "\n## 目 录\n定 价：3元\n文"] + [f"甲\n# 目录\n{x}\n# 二\n文" for x in lines]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kind", F.expr(matter.kind(SPARK, "text")))
    assert df.select("kind").distinct().count() == len(matter.BY_KIND)
    got = {r.doc_id: r.text for r in matter.apply_first(df).collect()}
    want = {r.doc_id: r.text for r in matter.apply(df, *matter.FIRST).collect()}
    assert got == want


def test_every_imprint_line_has_a_sign(spark):
    df = spark.createDataFrame([(x,) for x in [*ODD, *SIGNS]], "x string")
    got = df.selectExpr("x", f"{matter.is_imprint(SPARK, 'x')} AS imprint", f"{matter.kind(SPARK, 'x')} AS kind").filter("imprint")
    assert got.count() >= 5 and got.filter("kind < 2").count() == 0


def test_characters_are_counted_without_matches(spark):
    texts = ["", "a，b。c", "，，，", "𠀀字\n。。字", "x" * 50 + "?!", "漢字,kana 12"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for chars in (READABLE, CJK, GATE_PUNCTUATION, SCORE_PUNCTUATION):
        assert df.filter(f"{SPARK.chars('x', chars)} <> {SPARK.count('x', f'[{chars}]')}").count() == 0
        assert "regexp_count" not in SPARK.chars("x", chars)


def test_blocking_codes_alone(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(x for xs in CODES.values() for x in xs)], "doc_id long, text string")
    columns = ("doc_id", "accepted", "blocking")
    assert gate.gate(df, wanted=BLOCKING).select(*columns).orderBy("doc_id").collect() == gate.gate(df).select(*columns).orderBy("doc_id").collect()


def test_guard_measures_three_codes(spark):
    """Breaks, spaces and contents aren't looked for, as no reason names them."""
    plan = catalog.queries()["collapse_guard"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "short_lines" not in plan and "gaps#" not in plan and "declared" not in plan
