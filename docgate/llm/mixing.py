"""Mixing sources to target weights by weighted fair queueing.

Every source offers its documents in a random order, once for each time it may be repeated. A document's virtual
finish time is its source's words up to and with it, divided by the source's target, so that every source reaches its
target at time 1. The offers of all sources are range-sorted by that time and cut off where the budget is used up.

Running sums never meet in one task: a source's order is cut into buckets by the leading digits of the random key,
whose sums are few; the time order is cut by the range sort, and only the range in which the budget ends is gone
through document by document.

Targets: the budget is shared by weight, and a source's target stops at `most` times its words; what is above is
shared among the others by weight again. In closed form, sources in order of size over weight are full as long as
the share per weight of what is left exceeds theirs.

Defined results: a null text has no words; a null source is a source, last in order; a document without words takes
none; of documents that tie, a hash of their ids (of rows without one, their place in the input) decides, so reruns
agree; repeated rows are documents of their own;
an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgate.llm.common import WORD, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = "mix"
#: Documents of a bucket, at most about.
BUCKET = 512


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = REPEATS) -> DataFrame:
    """sizes: (source, source_size). Adds source_id (by code point, null last), budget (of all sources) and target.

    A row per source, as many as a corpus has sources: small next to its documents, so one task orders them."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "source_id")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_id") - 1) % len(weights) + 1).cast("int"))
    named = sizes.withColumn("source_id", F.row_number().over(by_name)).withColumn("weight", weight)
    named = named.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    filled = named.withColumn("full_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
    filled = filled.withColumn("level", (F.col("budget") - F.col("full_before")) / F.sum("weight").over(from_here))
    filled = filled.withColumn("is_full", F.col("level") * F.col("weight") >= F.col("source_size") * most)
    # the first source that isn't full has the level of all others
    open_level = F.min(F.when(~F.col("is_full"), F.struct((F.col("source_size") / F.col("weight")).alias("ratio"), "source_id", "level"))).over(everything)["level"]
    target = F.when(F.col("is_full"), (F.col("source_size") * most).cast("double")).otherwise(open_level * F.col("weight"))
    return filled.select("source", "source_id", "source_size", "budget", target.alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = REPEATS) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies."""
    rows = written(
        df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")).withColumn("row", F.monotonically_increasing_id()),
        "sizes",
    )
    sources = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    total = sources.agg(F.max("budget")).first()[0] or 0.0
    digits = min(6, max(1, math.ceil(math.log(max(1, rows.count() / BUCKET), 16))))
    one = rows.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).select("row", "doc_id", "size", "source_id", "source_size", "target")
    offers = one.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    offers = offers.withColumn("key", F.md5(F.concat_ws("|", F.lit(SEED), F.col("turn").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))))))
    offers = offers.withColumn("bucket", F.substring("key", 1, digits))
    place = ["source_id", "turn", "bucket"]
    sums = offers.groupBy(*place).agg(F.sum("size").alias("inside"))
    earlier = Window.partitionBy("source_id").orderBy("turn", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*place, F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*place).orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)
    timed = offers.withColumn("upto", F.sum("size").over(inside)).join(sums, place)
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("upto")) / F.col("target")).otherwise(F.lit(0.0))
    order = ["finish", "key", "row"]
    queue = timed.select("row", "doc_id", "size", "source_size", "target", finish.alias("finish"), "key")
    queue = written(queue.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "queue")
    # as many rows as there are ranges
    ranges = queue.groupBy("range").agg(F.sum("size").alias("in_range"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written(ranges.select("range", "in_range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("before_range")), "ranges")
    placed = queue.join(F.broadcast(ranges), "range")
    whole = F.col("before_range") + F.col("in_range") <= total
    cut = ~whole & (F.col("before_range") <= total)
    upto = F.col("before_range") + F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    columns = ["row", "doc_id", "size", "source_size", "target"]
    taken = placed.filter(~cut).select(*columns, whole.alias("taken")).unionByName(placed.filter(cut).withColumn("upto", upto).select(*columns, (F.col("upto") <= total).alias("taken")))
    out = taken.groupBy(*columns).agg(F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken"), F.count_if("taken").alias("copies"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of the mix with all their columns, each as often as the mix takes it. Rows equal in id and size take the larger number."""
    found = mix(df, id_col, text_col, source_col, **how).filter("copies > 0")
    found = written(found.groupBy(F.col("doc_id").alias("__id"), F.col("size").alias("__size")).agg(F.max("copies").alias("__copies")), "copies")
    same = df[id_col].eqNullSafe(found["__id"]) & (n_words(df[text_col]) == found["__size"])
    # what is taken has no size bound, so it may not be broadcast
    rows = df.join(found.hint("merge"), same).withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return rows.select(*df.columns)
