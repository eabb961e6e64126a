"""Secret scans over an incremental ledger of blobs, in DataFrame operations alone.

A version of a document is addressed by its content (SHA-256 of the text). The ledger is a table of (blob, rule
version, spans) in the shared folder. A scan finds the distinct blobs of the table by their addresses alone, keeps the
pairs of blob and rule version that the ledger lacks, and only these fetch their texts and are scanned; what they hold
(also nothing) is appended, and the ledger's findings are joined back to all rows. A text with a thousand copies or
historical versions equal to it is scanned once, and where nothing is new no text is moved. Two runs at once, or one
that was repeated, may append a blob twice, with equal spans; the ledger is read once a blob.

Spans come from two native functions: `regexp_extract_all` gives a pattern's matches and `split` by the same pattern
the texts between; running sums of their lengths are the places, in code points. Few matches are summed up in the row;
a text with more than `MANY` has them exploded and summed by a window over that text, so the work stays in proportion.

Defined results: a null text counts as empty and has no spans; no finding gives counts of zero, an empty spans
string and the SHA-256 of an empty string; repeated rows get equal results; an empty table gives an empty result.
A text of any length is scanned whole. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgate.llm.common import new_path, written

#: A kind's pattern, the group whose length counts, and its least length. Kinds stand in the order in which ties are listed.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Raised whenever RULES change, so that every blob is scanned anew.
RULE_VERSION = "1"
#: Matches of a text from which they are exploded.
MANY = 200
#: New blobs whose addresses (64 bytes each) are broadcast.
FEW = 100_000
SPAN = "struct<kind:string,rank:int,start:int,end:int>"


def _steps(text: Column, pattern: str, group: int) -> Column:
    """The matches of one pattern in their order: the length of the text before, of the match, and of what is judged."""
    regex = F.lit(pattern)
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    judged = F.regexp_extract_all(text, regex, F.lit(group))
    sizes = F.zip_with(matches, judged, lambda m, j: F.struct(F.length(m).alias("whole"), F.length(j).alias("judged")))
    steps = F.zip_with(F.split(text, pattern, -1), sizes, lambda b, m: F.struct(F.length(b).alias("gap"), m["whole"].alias("whole"), m["judged"].alias("judged")))
    found = F.filter(steps, lambda x: x["whole"].isNotNull())  # the text after the last match has none
    # most texts match nothing, and one search settles it
    return F.when(F.regexp_like(text, regex), found).otherwise(F.array().cast("array<struct<gap:int,whole:int,judged:int>>"))


def _spans(steps: Column, rank: int, kind: str, least: int) -> Column:
    """The steps that are long enough, as structs of start, rank, end and kind.

    Patterns are matched greedily before lengths are judged, so a short match still uses up what it covers. For runs
    of one class (access, hex) a least length in the pattern says the same, as a run is matched whole or not at all.
    """
    placed = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,judged:int>>").alias("found")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + x["whole"]).alias("at"),
            F.concat(s["found"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["whole"]).alias("end"), x["judged"].alias("judged")))).alias("found"),
        ),
    )["found"]
    return F.transform(F.filter(placed, lambda x: x["judged"] >= least), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _ordered(found: Column) -> Column:
    return F.transform(F.array_sort(found), lambda x: F.struct(x["kind"].alias("kind"), x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end")))


def scan(blobs: DataFrame, rules=RULES, many: int = MANY) -> DataFrame:
    """blobs: (blob, text). Returns (blob, spans), spans by start, kind as listed, end."""
    steps = [_steps(F.col("text"), pattern, group).alias(f"steps{rank}") for rank, (_, pattern, group, _) in enumerate(rules)]
    rows = written(blobs.select("blob", *steps), "secret-matches")
    names = [f"steps{rank}" for rank in range(len(rules))]
    size = sum((F.size(n) for n in names), F.lit(0))
    few = rows.filter(size <= many)
    found = F.concat(*(_spans(F.col(n), rank, kind, least) for rank, (n, (kind, _, _, least)) in enumerate(zip(names, rules, strict=True))))
    out = few.select("blob", _ordered(found).alias("spans"))
    crowded = rows.filter(size > many)
    each = None
    for rank, (n, (kind, _, _, least)) in enumerate(zip(names, rules, strict=True)):
        part = crowded.select("blob", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(least).alias("least"), F.posexplode(n).alias("k", "step")).select("blob", "rank", "kind", "least", "k", "step.*")
        each = part if each is None else each.unionByName(part)
    upto = F.sum(F.col("gap") + F.col("whole")).over(Window.partitionBy("blob", "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    spans = each.withColumn("end", upto).filter("judged >= least").select("blob", F.struct((F.col("end") - F.col("whole")).alias("start"), "rank", "end", "kind").alias("span"))
    spans = spans.groupBy("blob").agg(F.collect_list("span").alias("found"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    more = crowded.select("blob").join(spans, "blob", "left").select("blob", _ordered(F.coalesce("found", none)).alias("spans"))
    return out.unionByName(more)


LEDGER = f"blob string, spans array<{SPAN}>, rule_version string"


def _known(spark, ledger: str, version: str) -> DataFrame:
    """The ledger's rows for a rule version, one a blob."""
    return spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == version).dropDuplicates(["blob"])


def update(df: DataFrame, ledger: str, text_col: str = "text", rules=RULES, version: str = RULE_VERSION) -> DataFrame:
    """Scans the blobs of df that the ledger (a folder, made if there is none) lacks for this rule version. Returns the ledger's rows for the version."""
    spark = df.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    text = F.coalesce(F.col(text_col), F.lit(""))
    addressed = df.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    known = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == version)
    unseen = written(addressed.select("blob").distinct().join(known.select("blob"), "blob", "left_anti"), "unseen-blobs")
    new = unseen.count()
    if new:
        if new <= FEW:  # a bounded list goes to all tasks, so that only the texts it names are moved
            blobs = addressed.join(F.broadcast(unseen), "blob", "left_semi").dropDuplicates(["blob"])
        else:  # copies are dropped before the shuffle, so that none of them is a hot key
            blobs = addressed.dropDuplicates(["blob"]).join(unseen, "blob", "left_semi")
        scan(blobs, rules).withColumn("rule_version", F.lit(version)).write.mode("append").parquet(ledger)
    return _known(spark, ledger, version)


def findings(df: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules=RULES, version: str = RULE_VERSION) -> DataFrame:
    """One row per input row: doc_id, blob, spans. Without a ledger, a new one is made in the shared folder."""
    kept = update(df, ledger or new_path(df.sparkSession, "secret-ledger"), text_col, rules, version)
    rows = df.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    found = kept.filter(F.size("spans") > 0).select("blob", "spans")
    return rows.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def joined(column: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def report(found: DataFrame, rules=RULES) -> DataFrame:
    """Of findings: doc_id, a count for each kind, the SHA-256 of the joined spans, and these."""
    counts = [F.size(F.filter("spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind, *_ in rules]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
