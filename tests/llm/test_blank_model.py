def test_a_model_that_learned_nothing_scores_the_share_and_drops_nothing(spark):
    from docgate.llm.toxicity import fit, keep, score

    docs = spark.createDataFrame([(i, f"clean text {i}") for i in range(20)], "doc_id long, text string")
    for toxic in ([1] * 20, [i % 2 for i in range(20)]):
        model = fit(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
        made = score(docs, model).collect()
        assert len({r.score for r in made}) == 1 and made[0].score >= 0.3
        assert {r.predicted for r in made} == {1} and keep(docs, model).count() == 20
    few = score(docs, fit(docs, spark.createDataFrame([(i, int(i == 0)) for i in range(20)], "doc_id long, toxic int"))).collect()
    assert len({r.score for r in few}) == 1 and few[0].score < 0.3 and {r.predicted for r in few} == {0}
