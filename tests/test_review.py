from docgate.operators import review


class Fake:
    """Finds a dollar sign to be an issue, and fails on the word boom."""

    def complete_json(self, prompt):
        text = prompt.split("Text:\n")[1]
        if "boom" in text:
            raise RuntimeError("service down")
        issues = [{"id": "1", "category": "latex_artifact", "severity": "major", "excerpt": "$9$", "safe_fix_type": "rule_fix"}] if "$" in text else []
        return {"status": "reviewed", "accepted": True, "confidence": 0.5 + 0.1 * len(text), "issues": issues}


def test_review_chain(spark):
    chunks = spark.createDataFrame([(1, 1, "ab"), (1, 2, "c $9$ d"), (2, 1, "ok"), (3, 1, "boom"), (4, 1, "ok")], "doc_id long, chunk_index int, text string")
    asked = review.prompts(chunks, "review")
    judged = review.verdicts(review.call(asked, Fake()))
    got = {r.doc_id: r for r in review.rollup(judged).collect()}
    assert {i: r.accepted for i, r in got.items()} == {1: False, 2: True, 3: False, 4: True}
    assert got[1].failed_chunks == 1 and got[1].issues[0].chunk_index == 2 and got[3].error_chunks == 1 and got[2].confidence == 0.7
    assert {r.doc_id: r.may_finish for r in review.may_finish(judged).collect()} == {1: False, 3: False}
    texts = spark.createDataFrame([(1, "ab\n\nc $9$ d")], "doc_id long, text string")
    issues = review.rollup(judged).selectExpr("doc_id", "explode(issues) as i").selectExpr("doc_id", "i.issue as issue")
    for new, skipped in (("9", None), ("8", "numeric_tokens_changed"), ("$9$", "no_deterministic_change")):
        checked = review.patches(texts, issues, spark.createDataFrame([("$9$", new)], "excerpt string, new string"))
        assert [r.skipped for r in checked.collect()] == [skipped]
        assert review.patched(texts, checked).first().text == ("ab\n\nc 9 d" if skipped is None else "ab\n\nc $9$ d")
    fixed = spark.createDataFrame([(1, 2, "c 9 d")], "doc_id long, chunk_index int, text string")
    assert {r.doc_id: r.text for r in review.merged(chunks, fixed).collect()}[1] == "ab\n\nc 9 d"


def test_cached_answers_are_not_asked_again(spark):
    class Never:
        def complete_json(self, prompt):
            raise AssertionError("called")

    asked = review.prompts(spark.createDataFrame([(1, 1, "ab")], "doc_id long, chunk_index int, text string"), "accept", context=True)
    cache = asked.selectExpr("prompt_sha256", """'{"status": "passed"}' as answer""")
    assert [r.accepted for r in review.verdicts(review.call(asked, Never(), cache)).collect()] == [True]


def test_breaker_lets_calls_through_after_recovery(spark):
    class Outage:
        """Down for half a second from the first call of a task on."""

        up = None

        def complete_json(self, prompt):
            import time

            self.up = self.up or time.monotonic() + 0.5
            if time.monotonic() < self.up:
                raise RuntimeError("service down")
            return {"status": "passed"}

    asked = review.prompts(spark.createDataFrame([(i, 1, f"t{i}") for i in range(40)], "doc_id long, chunk_index int, text string"), "accept")
    judged = review.verdicts(review.call(asked, Outage(), recovery=1.0)).collect()
    assert len(judged) == 40 and sum(r.accepted for r in judged) >= 32  # a task of at most four loses two prompts


def test_json_in_answers():
    assert review.json_object('```json\n{"a": 1}\n```') == {"a": 1} and review.json_object('so: {"a": {"b": 2}} end') == {"a": {"b": 2}}
    for bad in ("[1]", "none", "{"):
        try:
            review.json_object(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_spend(spark):
    calls = spark.createDataFrame([("d", 1, 1.0), ("d", 2, None), ("d", 3, 1.5), ("d", 4, 0.1)], "document_id string, call_index int, estimated_cost double")
    assert [r.call_index for r in review.spend(calls, 10, 2.5).orderBy("call_index").collect()] == [1, 2, 3]
    assert review.spend(calls, 1, 9.0).count() == 1
