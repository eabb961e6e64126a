"""Exact dedup with a heavy-hitter split, in DataFrame operations alone.

Texts are equal when identical after lower-casing A-Z; a SHA-256 of the normalised text stands for it. A
Misra-Gries pass (`freqItems`, one aggregate with bounded counters in each task) names the digests that may hold
more than `support` of all rows: at most 1/support of them, so they can be broadcast whatever the input. Their
exact sizes and winners come from a map-side aggregate over these digests alone and are joined back by broadcast,
so that the rows of a hot digest never meet in a task. All other digests go through an ordinary shuffle: an aggregate
with map-side combining, joined back to the rows, so that no group of them is gathered either.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays, of rows that
tie on it exactly one; a null doc_id is smaller than any other and stays null in keep_id; an empty table gives an
empty result. A text of any length is read whole, by its digest; repeated rows are copies of one another. Other columns of
the input are ignored by `decide`, whatever their names; `keep` returns them, but for columns named like its own, which
begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgate.llm.common import lower_ascii, written

#: A digest with at least this share of the rows is split off; 1/SUPPORT candidates at most are broadcast.
SUPPORT = 0.001


def digest(text: Column) -> Column:
    return F.sha2(lower_ascii(text), 256)


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(
        df.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256")).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    found = rows.freqItems(["text_sha256"], support)
    likely = F.broadcast(found.select(F.explode("text_sha256_freqItems").alias("text_sha256")))
    winner = [F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size")]
    hot = written(rows.join(likely, "text_sha256", "left_semi").groupBy("text_sha256").agg(*winner), "hot-digests")
    hot_rows = rows.join(F.broadcast(hot), "text_sha256")
    cold = rows.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti")
    cold_rows = cold.join(cold.groupBy("text_sha256").agg(*winner), "text_sha256")
    return hot_rows.select(*cold_rows.columns).unionByName(cold_rows).select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256"
    )


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with all their columns. Of rows equal in id and text alike, one stays."""
    kept = decide(df, id_col, text_col, support).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"))
    rows = df.withColumn("__digest", digest(F.col(text_col))).withColumn("__row", F.monotonically_increasing_id())
    same = rows[id_col].eqNullSafe(kept["__id"]) & (rows["__digest"] == kept["__digest"])
    # ids that repeat are few or none; only their rows are counted out
    again = written(df.groupBy(F.col(id_col).alias("__again")).count().filter("count > 1").select("__again"), "repeated-ids")
    # what is kept has no size bound, so it may not be broadcast
    left = rows.join(kept.hint("merge"), same, "left_semi")
    if not again.isEmpty():
        repeated = left.join(again, left[id_col].eqNullSafe(again["__again"]), "left_semi")
        first = Window.partitionBy(id_col, "__digest").orderBy("__row")
        one = repeated.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
        left = left.join(again, left[id_col].eqNullSafe(again["__again"]), "left_anti").unionByName(one)
    return left.select(*df.columns)
