from docgate.functions.dialect import over
from docgate.operators import tail
from tests.test_engine import agree

BODY = "\n".join(f"第{i}段正文，写得不短。" for i in range(24))
HEADS = "\n".join(f"## {i}. 题" for i in range(1, 10))
#: text, what stays (None: all), what is cut off
CASES = [
    (BODY, None, None),
    (f"{BODY}\nSS号=123456\n书名=某书\n尾", f"{BODY}\n", "record"),
    (f"{BODY}\n\n# 1. 甲\n\n| 书名 = 某书 |\n", f"{BODY}\n", "record"),
    (f"SS号=123456\n{BODY}\n" + BODY * 3, None, None),  # not in the rear
    (f"{BODY}\n一段长长的正文写到这里就完了正文正文正文。[General Information]书名=某书\n作者=某人\n\nSSID=1\n", f"{BODY}\n一段长长的正文写到这里就完了正文正文正文。\n", "glued"),
    (f"{BODY}\n正文。SS号=12345\n又一段\n", f"{BODY}\n正文。\n又一段\n", "glued"),
    (f"{BODY}\n正文SS号=12345", None, None),  # right behind a character
    (f"{BODY}\n{HEADS}", f"{BODY}\n", "headings"),
    (f"{BODY}\n{HEADS}\n文", None, None),  # the last heading has a text
    ("\n".join(BODY.split("\n")[:10]) + f"\n{HEADS}", None, None),  # fewer than 20 lines would stay
    (f"{BODY}\n" + "\n".join(HEADS.split("\n")[:7]), None, None),
    (f"一\n二\n三\n{HEADS}\nSS号=12345", None, None),  # fewer than 5 lines would stay
    ("SS号=12345\n甲", None, None),  # fewer than 8 lines
    ("", None, None),
]


def test_examples(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.cut) for r in over(df, tail.cut).collect()}
    assert got == {i: (t if want is None else want, kind) for i, (t, want, kind) in enumerate(CASES)}


def test_query_agrees_with_sql_written_separately(spark):
    agree(spark, "trailing_archive_cut")
