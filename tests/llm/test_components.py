import random


def brute(links):
    up = {x: x for link in links for x in link}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up if top(x) != x}


def ran(spark, run):
    """What `run` returns, and the plans it ran meanwhile, each as the names of its nodes."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    result = run()
    bus.waitUntilEmpty()
    plans, found = [], store.executionsList()
    for k in range(before, found.size()):
        nodes = store.planGraph(found.apply(k).executionId()).allNodes()
        plans.append([nodes.apply(i).name() for i in range(nodes.size())])
    return result, plans


def graphs():
    rng = random.Random(4)
    yield [(0, k) for k in range(1, 300)]
    yield [(k, k + 1) for k in range(90)]
    yield [(k, k + 1) for k in range(90, 0, -1)] + [(5, 5), (200, 200)]
    yield [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    yield [(rng.randrange(60), 1000) for _ in range(60)] + [(-(10**15), 59), (70, 71), (71, 70), (70, 71)]
    yield [(3, 3)]
    yield []


def test_every_node_hangs_on_the_smallest_of_its_component(spark):
    from docgate.llm.components import components

    for links in graphs():
        want = sorted(brute(links).items())
        for how in ({}, {"few": 0}):
            found = components(spark.createDataFrame(links, "a long, b long"), **how).collect()
            assert sorted((r.node, r.root) for r in found) == want


def test_links_that_are_stars_need_no_round(spark):
    """A round that only finds out that nothing changes costs some ten jobs."""
    from docgate.llm.components import components

    links = spark.createDataFrame([(k % 7, 100 + k) for k in range(200)] + [(300, 8), (8, 8)], "a long, b long")
    found, plans = ran(spark, lambda: components(links))
    assert found.count() == 201
    assert len(plans) == 2


def test_a_round_of_few_links_shuffles_for_its_aggregates_alone(spark):
    from docgate.llm.components import components

    links = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, plans = ran(spark, lambda: components(links))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.root for r in found.collect()} == {0}
    rounds = [p for p in plans if any("Join" in n for n in p)]
    assert rounds
    for names in rounds:
        assert sum(n == "Exchange" for n in names) <= 4
        assert not any("SortMergeJoin" in n for n in names)
