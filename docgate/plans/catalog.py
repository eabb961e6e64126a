"""The registered queries: each is SQL built for Spark, and the same query built for DuckDB to check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgate.functions.dialect import DUCK, SPARK, Dialect, over
from docgate.functions.lexicon import BLOCKING, CODES
from docgate.operators import clean, finalize, folds, formulas, gate, index, matter, recognised, structure, tail
from docgate.plans import dirty, plain, relational, scaled

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")
SQL: dict[str, Callable[[Dialect], str]] = {}
#: Codes of bad segmentation.
SEGMENTATION = ("mega_line", "low_heading_density", "headingless_long_document")


def query(build: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    SQL[build.__name__] = build
    return build


def dirty_source(d: Dialect) -> str:
    return f"({dirty.view(d)}) dirty"


@query
def gate_acceptance(d: Dialect) -> str:
    return f"SELECT doc_id, accepted, {d.join('blocking', ',')} AS blocking, {d.join('warnings', ',')} AS warnings FROM ({gate.gated(d, dirty_source(d))}) g"


@query
def quality_hints(d: Dialect) -> str:
    return gate.hinted(d, dirty_source(d))


@query
def gate_error_counts(d: Dialect) -> str:
    rows = d.explode(f"({gate.gated(d, dirty_source(d))}) g", "errors", "doc_id")
    return f"SELECT item AS code, cast(count(*) as bigint) AS documents FROM ({rows}) x GROUP BY item"


@query
def gate_summary_by_lang(d: Dialect) -> str:
    return f"""SELECT lang, cast(count(*) as bigint) AS documents, cast(sum(CASE WHEN accepted THEN 1 ELSE 0 END) as bigint) AS accepted,
        cast(sum({d.size('blocking')}) as bigint) AS blocking_codes, cast(max(max_line_chars) as bigint) AS longest_line
        FROM ({gate.gated(d, dirty_source(d))}) g JOIN (SELECT doc_id AS id, lang FROM documents) l ON g.doc_id = l.id GROUP BY lang"""


@query
def text_measures(d: Dialect) -> str:
    return f"""SELECT doc_id, total_chars, readable_chars, chinese_chars, punctuation_count, score_punctuation, line_count, max_line_chars, heading_count,
        forced_breaks, running_repeats, short_repeats, toc_headings FROM ({gate.measures(d, dirty_source(d))}) m"""


@query
def candidate_score(d: Dialect) -> str:
    return f"SELECT doc_id, points, usable, forced_breaks, short_repeats FROM ({gate.scored(d, dirty_source(d))}) s"


@query
def candidate_select(d: Dialect) -> str:
    """The raw text against the view with artefacts, as two extractions of one document."""
    first, second = gate.scored(d, dirty_source(d)), gate.scored(d, "documents")
    return f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.points AS primary_points, b.points AS secondary_points,
        CASE WHEN a.usable AND b.usable THEN CASE WHEN abs(a.points - b.points) <= 50000 OR a.points > b.points THEN 'primary' ELSE 'secondary' END
             WHEN a.usable THEN 'primary' WHEN b.usable THEN 'secondary' END AS winner
        FROM ({first}) a FULL OUTER JOIN ({second}) b ON a.doc_id = b.doc_id"""


@query
def clean_text(d: Dialect) -> str:
    return f"SELECT doc_id, cast(length(text) as bigint) AS chars, {d.sha256('text')} AS text_sha256 FROM ({clean.cleaned(d, dirty_source(d))}) c"


@query
def clean_rule_audit(d: Dialect) -> str:
    return f"SELECT * FROM ({clean.audit(d, dirty_source(d))}) a"


@query
def clean_rule_counts(d: Dialect) -> str:
    return f"SELECT rule_id, risk_level, cast(count(*) as bigint) AS documents, cast(sum(match_count) as bigint) AS matches FROM ({clean.audit(d, dirty_source(d))}) a GROUP BY rule_id, risk_level"


@query
def clean_html_tables(d: Dialect) -> str:
    made = clean.steps(d, "html", clean.TABLE_STEPS)
    return f"SELECT page_id, cast(length({made}) as bigint) AS chars, {d.sha256(made)} AS text_sha256 FROM pages"


def _line_query(name: str, build) -> None:
    def made(d: Dialect) -> str:
        lines = build(d, dirty_source(d))
        return f"SELECT doc_id, {d.sha256('text')} AS text_sha256, cast(length(text) as bigint) AS chars FROM ({structure.packed(d, lines)}) p"

    SQL[name] = made


for _name, _build in (
    ("running_headers_removed", structure.without_running), ("book_titles_removed", structure.without_titles), ("dedupe_short_lines", structure.without_short_repeats),
    ("heading_relevel", structure.relevelled), ("demote_headings", structure.demoted), ("toc_page_headings", structure.page_headings),
    ("heading_echo_removed", structure.without_echo), ("front_prefix_removed", structure.without_prefix), ("heading_page_suffix", structure.without_page_suffix),
):
    _line_query(_name, _build)


def _on_lines(build):
    return lambda d, source: build(d, structure.rows(d, source))


for _name, _build in matter.MATTER.items():
    _line_query(_name, _on_lines(_build))


@query
def heading_level_cap(d: Dialect) -> str:
    return structure.heading_levels(d, dirty_source(d))


@query
def toc_declared_titles(d: Dialect) -> str:
    return structure.declared_titles(d, dirty_source(d))


@query
def heading_spacing(d: Dialect) -> str:
    lines = structure.spaced(d, dirty_source(d))
    return f"SELECT doc_id, {d.sha256('text')} AS text_sha256 FROM (SELECT doc_id, {d.join(d.gather('line', 'pos * 3 + sub'), chr(10))} AS text FROM ({lines}) s GROUP BY doc_id) p"


@query
def chunk_units(d: Dialect) -> str:
    return f"SELECT doc_id, unit, cast(length(text) as bigint) AS chars, {d.sha256('text')} AS text_sha256 FROM ({structure.units(d, dirty_source(d))}) u"


@query
def strip_latex(d: Dialect) -> str:
    made = clean.steps(d, "text", clean.REPAIR_STEPS)
    return f"SELECT doc_id, {d.sha256(made)} AS text_sha256 FROM {dirty_source(d)}"


SQL.update({build.__name__: build for build in relational.RELATIONS})


def _cleaned_source(d: Dialect) -> str:
    return f"(SELECT doc_id, text FROM ({clean.cleaned(d, dirty_source(d))}) c) cleaned"


@query
def local_gate(d: Dialect, cleaned: str | None = None) -> str:
    """The whole local run: clean every text, gate the result, and say what may be delivered under which hash."""
    cleaned = cleaned or _cleaned_source(d)
    return f"SELECT doc_id, accepted, {d.join('blocking', ',')} AS blocking, CASE WHEN accepted THEN {d.sha256('text')} END AS final_sha256 FROM ({gate.gated(d, cleaned)}) g"


@query
def collapse_guard(d: Dialect, cleaned: str | None = None) -> str:
    """Cleaning against what it was given: a result that grew a mega line, lost its headings or gained a code of bad segmentation isn't taken."""
    # given the cleaned texts, no other codes are measured
    wanted = SEGMENTATION if cleaned else CODES
    cleaned = cleaned or _cleaned_source(d)
    a, b = gate.gated(d, dirty_source(d), wanted), gate.gated(d, cleaned, wanted)
    gained = [f"CASE WHEN {d.has('b.errors', d.text(c))} AND NOT {d.has('a.errors', d.text(c))} THEN {d.text('candidate_has_' + c)} END" for c in SEGMENTATION]
    reasons = d.filter(d.array(
        "CASE WHEN b.max_line_chars >= 3000 AND b.max_line_chars > greatest(a.max_line_chars * 2, a.max_line_chars + 500) THEN 'candidate_mega_line' END",
        "CASE WHEN a.heading_count >= 10 AND b.heading_count < greatest(5, floor(a.heading_count / 3.0)) THEN 'candidate_heading_collapse' END", *gained), "x", "x IS NOT NULL")
    return f"""SELECT a.doc_id, a.heading_count AS headings_before, b.heading_count AS headings_after, a.max_line_chars AS longest_before, b.max_line_chars AS longest_after,
        {d.join(reasons, ',')} AS reasons, {d.size(reasons)} > 0 AS fall_back FROM ({a}) a JOIN ({b}) b ON a.doc_id = b.doc_id"""


def spread(df: DataFrame, name: str) -> DataFrame:
    """Texts that stand in fewer row groups than there are cores are dealt out; more aren't touched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def _views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    for name in TABLES:
        if name in sql:
            spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name).createOrReplaceTempView(name)


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = scaled.PLANS.get(name, SQL[name])(SPARK)
        _views(spark, sf_dir, sql)
        return spark.sql(sql)

    return call


def _on_cleaned(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of cleaned texts in two statements: as one it takes Spark's analyser more passes than it makes."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        cleaned = over(_dirty(spark, sf_dir), clean.cleaned).select("doc_id", "text")
        return over(cleaned, lambda d, x: SQL[name](d, x))

    return call


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = dirty.view(SPARK)
    _views(spark, sf_dir, sql)
    return spark.sql(sql).select("doc_id", "text")


def _fold(*names: str) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return folds.apply(_dirty(spark, sf_dir), *names).selectExpr("doc_id", "sha2(text, 256) AS text_sha256", "cast(length(text) as bigint) AS chars")

    return call


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.chunked(_dirty(spark, sf_dir)).selectExpr("doc_id", "chunk_index", "chunk_total", "length(text) AS chars")


def front_and_back_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operators on front and back matter and heading levels, one after another."""
    made = matter.apply(_dirty(spark, sf_dir), *matter.MATTER)
    return made.selectExpr("doc_id", "sha2(text, 256) AS text_sha256", "cast(length(text) as bigint) AS chars")


def front_and_back_matter_sql(d: Dialect = DUCK) -> str:
    """The same as one statement, which is too deep for Spark's analyser to take at once."""
    lines = structure.rows(d, dirty_source(d))
    for operator in matter.MATTER.values():
        lines = matter.again(d, operator(d, lines))
    return f"SELECT doc_id, {d.sha256('text')} AS text_sha256, cast(length(text) as bigint) AS chars FROM ({structure.packed(d, lines)}) p"


def clean_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain of cleaning rules, folds among them."""
    made = clean.with_audit(_dirty(spark, sf_dir))
    return made.selectExpr("doc_id", "sha2(text, 256) AS text_sha256", "cast(length(text) as bigint) AS chars", "cast(size(audit) as bigint) AS changes")


def clean_chain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clean.rule_changes(_dirty(spark, sf_dir))
    return made.groupBy("rule_id", "risk_level").agg(F.count(F.lit(1)).alias("documents"), F.sum("match_count").alias("matches"))


def finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, structure put right, repaired, gated: what of the documents could be delivered."""
    made = finalize.repair(finalize.finalize(clean.clean(_dirty(spark, sf_dir))))
    return gate.gate(made, wanted=BLOCKING).selectExpr("doc_id", "accepted", "array_join(blocking, ',') AS blocking", "sha2(text, 256) AS text_sha256")


def structure_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = finalize.finalize(clean.clean(_dirty(spark, sf_dir))).selectExpr("explode(changes) AS change")
    return changed.groupBy("change.step").agg({"*": "count"}).withColumnRenamed("count(1)", "documents")


for _name in recognised.RECOGNISED:
    SQL[_name] = lambda d, name=_name: recognised.rewritten(d, dirty_source(d), name)

#: Without SQL to check them by: each line reads what the line before became.
FOLDED = {
    "clean_tables": _fold("normalize_tables"), "soft_join": _fold("soft_join"),
    "merge_breaks": _fold("merge_breaks"), "split_overlong": _fold("split_overlong"), "clean_folds": _fold(*folds.FOLDS), "chunk_pack": chunk_pack, "finalized": finalized, "structure_changes": structure_changes, "clean_chain": clean_chain, "clean_chain_counts": clean_chain_counts,
}


def _rewritten(build: Callable[[Dialect, str], str], *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of texts that a relation makes, by their digests; its SQL to check by is written separately."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return over(_dirty(spark, sf_dir), build).selectExpr("doc_id", "sha2(text, 256) AS text_sha256", *columns)

    return call


STAGED = {name: _on_cleaned(name) for name in ("local_gate", "collapse_guard")}

#: Checked by the SQL in `plain`, or above.
REWRITTEN = {"front_and_back_matter": front_and_back_matter, "index_normalised": _rewritten(index.normalised, "entries"), "trailing_archive_cut": _rewritten(tail.cut, "cut"), "formulas_merged": _rewritten(formulas.merged, "joins")}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run(name) for name in SQL} | STAGED | FOLDED | REWRITTEN


def oracle_sql() -> dict[str, str]:
    return {name: build(DUCK) for name, build in SQL.items()} | {name: build() for name, build in plain.PLAIN.items()} | {"front_and_back_matter": front_and_back_matter_sql()}


assert len(set(CODES)) == len(CODES)
