"""Model review of chunks: prompts, calls through an injected client, and the relations on their verdicts.

The client is any object with `complete_json(prompt) -> dict`; it travels to the executors with the function. Calls are
keyed by the hash of their prompt: `call` first takes what the cache table has, and calls only for the rest, so a task
that runs again costs no second call for what has been stored. Everything but the call itself is a relation.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEVERE = ("blocking", "major")
PATCH_CATEGORIES, PATCH_TYPES = ("latex_artifact",), ("rule_fix", "safe_llm_patch")
FINISHING = ("layout", "ocr_noise", "punctuation")
CONTEXT = 1200
ISSUE = "struct<id:string,category:string,severity:string,location_hint:string,excerpt:string,reason:string,suggested_action:string,safe_fix_type:string>"
RESULT = f"struct<status:string,accepted:boolean,confidence:double,summary:string,issues:array<{ISSUE}>,blocking_issues:array<{ISSUE}>,corrected_text:string,repaired_text:string,manual_review_notes:array<string>>"
#: What a model is asked for, by stage; the text to judge stands behind.
TASKS = {
    "review": "Review the chunk. Answer as JSON with status, accepted, confidence, issues and manual_review_notes.",
    "correct": "Correct recognition errors without adding or removing content. Answer as JSON with status, confidence, corrected_text and changes.",
    "accept": "Decide whether the chunk may be delivered. Answer as JSON with status, accepted and blocking_issues.",
    "repair": "Repair only the issues that are listed. Answer as JSON with status, confidence and repaired_text.",
}


class Client(Protocol):
    def complete_json(self, prompt: str) -> dict: ...


def prompts(chunks: DataFrame, stage: str, profile: str = "general_standard_document", context: bool = False) -> DataFrame:
    """chunks: (doc_id, chunk_index, text). Adds stage, prompt and prompt_sha256; with the ends of its neighbours, if wanted."""
    parts = [F.lit(TASKS[stage]), F.lit(f"Profile: {profile}")]
    if context:
        order = Window.partitionBy("doc_id").orderBy("chunk_index")
        chunks = chunks.withColumn("before", F.coalesce(F.lag("text").over(order), F.lit(""))).withColumn("behind", F.coalesce(F.lead("text").over(order), F.lit("")))
        parts += [F.concat(F.lit("Before:\n"), F.expr(f"right(before, {CONTEXT})")), F.concat(F.lit("Behind:\n"), F.expr(f"left(behind, {CONTEXT})"))]
    prompt = F.concat_ws("\n\n", *parts, F.concat(F.lit("Text:\n"), F.col("text")))
    return chunks.withColumns({"stage": F.lit(stage), "prompt": prompt, "prompt_sha256": F.sha2(prompt, 256)}).drop("before", "behind")


def json_object(content: str) -> dict:
    """The JSON object in a model's answer: as it is, in a code fence, or between the outermost braces."""
    bare = re.sub(r"^```(?:json)?\s*|\s*```$", "", content.strip())
    start, stop = bare.find("{"), bare.rfind("}")
    for part in (bare, bare[start : stop + 1] if 0 <= start < stop else ""):
        try:
            value = json.loads(part)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    raise ValueError("no JSON object in the answer")


def call(asked: DataFrame, client: Client, cache: DataFrame | None = None, attempts: int = 3, breaker: int = 5, recovery: float = 60.0) -> DataFrame:
    """asked: rows with prompt and prompt_sha256. Adds answer (JSON). An answer that failed has status error.

    After `breaker` failures in a row a task waits `recovery` seconds before it tries its next prompt, with one call; a call that succeeds closes the breaker."""
    wanted = asked.select("prompt_sha256", "prompt").dropDuplicates(["prompt_sha256"])
    if cache is not None:
        wanted = wanted.join(cache.select("prompt_sha256"), "prompt_sha256", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failures, opened = 0, 0.0
        for batch in batches:
            answers = []
            for prompt in batch.column("prompt").to_pylist():
                answer: dict = {}
                if half_open := failures >= breaker:
                    time.sleep(max(0.0, opened + recovery - time.monotonic()))
                for _ in range(1 if half_open else attempts):
                    try:
                        answer = client.complete_json(prompt)
                        failures = 0
                        break
                    except Exception as e:  # a client may fail in any way; the row says how
                        answer, failures = {"status": "error", "error": str(e)[:500]}, failures + 1
                        opened = time.monotonic()
                answers.append(json.dumps(answer, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column("prompt_sha256"), pa.array(answers, pa.string())], ["prompt_sha256", "answer"])

    made = wanted.mapInArrow(run, "prompt_sha256 string, answer string")
    if cache is not None:
        made = made.unionByName(cache.select("prompt_sha256", "answer"))
    return asked.join(made, "prompt_sha256")


def verdicts(answered: DataFrame) -> DataFrame:
    """Parses answers: result, issues (of either kind), whether the chunk is accepted: it says so, and has no severe issue; and whether a corrected text makes a draft."""
    result = F.from_json("answer", RESULT, {"mode": "PERMISSIVE"})
    rows = answered.withColumn("result", result)
    none = F.array().cast(f"array<{ISSUE}>")
    issues = F.concat(F.coalesce("result.issues", none), F.coalesce("result.blocking_issues", none))
    severe = F.exists(issues, lambda x: F.lower(F.trim(x["severity"])).isin(*SEVERE))
    status = F.coalesce("result.status", F.lit("error"))
    corrected = F.trim(F.coalesce("result.corrected_text", F.lit("")))
    said = F.when(F.col("stage") == "review", (status == "reviewed") & F.coalesce("result.accepted", F.lit(False)) & ~severe).otherwise(status == "passed")
    return rows.withColumns({"status": status, "issues": issues, "accepted": F.coalesce(said, F.lit(False)), "draft_ready": (status == "passed") & (corrected != "")})


def rollup(judged: DataFrame) -> DataFrame:
    """A row per document: accepted if all its chunks are, failed chunks, least confidence, issues with their chunk."""
    own = F.transform("issues", lambda x: F.struct(F.col("chunk_index").alias("chunk_index"), x.alias("issue")))
    rows = judged.withColumn("own", own)
    return rows.groupBy("doc_id").agg(
        F.every("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("failed_chunks"), F.count_if(F.col("status") == "error").alias("error_chunks"), F.min("result.confidence").alias("confidence"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "own"))), lambda x: x["own"])).alias("issues"),
    )


def may_finish(judged: DataFrame) -> DataFrame:
    """Documents that failed only on what finishing mends: layout (a break in the excerpt, or a merge asked for), noise, punctuation."""
    safe = lambda x: x["category"].isin(*FINISHING) & ((x["category"] != "layout") | F.contains(F.coalesce(x["excerpt"], F.lit("")), F.lit("\n")) | F.contains(F.lower(F.coalesce(x["suggested_action"], F.lit(""))), F.lit("merge")))
    failed = judged.filter(~F.col("accepted"))
    return failed.groupBy("doc_id").agg(F.every((F.size("issues") > 0) & F.forall("issues", safe)).alias("may_finish"))


def numbers(text):
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))


def patches(texts: DataFrame, issues: DataFrame, replacement: DataFrame) -> DataFrame:
    """texts: (doc_id, text); issues: (doc_id, issue); replacement: (excerpt, new). A row per severe issue: applied, or the reason why not.

    Only an excerpt of at most 240 characters that stands in its text once, and whose numbers stay, is replaced."""
    severe = issues.filter(F.lower(F.trim("issue.severity")).isin(*SEVERE)).withColumn("excerpt", F.trim(F.coalesce("issue.excerpt", F.lit(""))))
    rows = severe.join(texts, "doc_id").join(replacement, "excerpt", "left")
    times = (F.length("text") - F.length(F.replace("text", F.col("excerpt"), F.lit("")))) / F.length("excerpt")
    reason = (
        F.when(~(F.col("issue.category").isin(*PATCH_CATEGORIES) & F.col("issue.safe_fix_type").isin(*PATCH_TYPES)), "not_safe_patch_candidate")
        .when(F.col("excerpt") == "", "missing_excerpt").when(F.col("new").isNull() | (F.col("new") == "") | (F.col("new") == F.col("excerpt")), "no_deterministic_change")
        .when((F.length("excerpt") > 240) | (F.length("new") > 240), "excerpt_too_large").when(times != 1, "excerpt_not_unique").when(numbers(F.col("excerpt")) != numbers(F.col("new")), "numeric_tokens_changed")
    )
    return rows.select("doc_id", "issue", "excerpt", "new", reason.alias("skipped"))


def patched(texts: DataFrame, checked: DataFrame) -> DataFrame:
    """texts with the patches that passed put in, one after another; a document has few."""
    swaps = checked.filter("skipped is null").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("excerpt", "new"))).alias("swaps"))
    put = F.aggregate("swaps", F.col("text"), lambda t, s: F.replace(t, s["excerpt"], s["new"]))
    return texts.join(swaps, "doc_id", "left").select("doc_id", F.when(F.col("swaps").isNull(), F.col("text")).otherwise(put).alias("text"))


def merged(chunks: DataFrame, repaired: DataFrame) -> DataFrame:
    """Chunks, each as repaired if it was, put together in order with blank lines: doc_id, text."""
    both = chunks.join(repaired.select("doc_id", "chunk_index", F.col("text").alias("repaired")), ["doc_id", "chunk_index"], "left")
    rows = both.select("doc_id", "chunk_index", F.coalesce("repaired", "text").alias("text"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def spend(calls: DataFrame, most_calls: int, most_cost: float) -> DataFrame:
    """calls: (document_id, call_index, estimated_cost). Those within a document's budget of calls and cost, in order."""
    order = Window.partitionBy("document_id").orderBy("call_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = calls.withColumns({"spent": F.sum(F.coalesce("estimated_cost", F.lit(0.0))).over(order), "nth": F.count(F.lit(1)).over(order)})
    return rows.filter((F.col("nth") <= most_calls) & (F.col("spent") <= most_cost)).drop("nth")
