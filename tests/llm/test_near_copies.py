import random

from tests.llm.cases import documents, frame, words


def brute(texts, least=0.8):
    """{place: least place of its class}, by the Jaccard index of the sets of five words in a row."""
    sets = []
    for text in texts:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    up = list(range(len(texts)))
    for _ in up:
        before = list(up)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if up[i] != up[j] and len(a & b) >= least * len(a | b):
                    low, high = sorted((up[i], up[j]))
                    up = [low if x == high else x for x in up]
        if before == up:
            break
    return up


def changed(rng, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_pipeline_stage_drops_near_copies_from_0_8(spark):
    import corpus_pipeline

    rng = random.Random(3)
    texts = []
    for _ in range(40):
        base = words(rng, 300, 5000)
        texts += [base, *(changed(rng, base, n) for n in (1, 4, 6, 7, 12))]
    chain = [words(rng, 200, 5000)]
    for _ in range(6):
        chain.append(changed(rng, chain[-1], 3))
    texts += chain + [words(rng, rng.randrange(1, 9)) for _ in range(20)]
    df = frame(spark, [(i, t, None, "a", None, 7, "x", 0.5, "k", 1, "h", None) for i, t in enumerate(texts)])
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(brute(texts)))


def test_edge_cases(spark):
    from docgate.llm.near_copies import keep

    rows = documents()
    kept = keep(frame(spark)).collect()
    up = brute([r[1] for r in rows])
    of = {(r[0], r[1]): u for r, u in zip(rows, up, strict=True)}
    assert sorted(of[r.doc_id, r.text] for r in kept) == sorted(set(up))
    assert keep(frame(spark, [])).count() == 0


def test_groups_around_a_hub_are_compared_in_blocks(spark):
    """Copies near one text and not near each other, with crowded places and small blocks."""
    from docgate.llm.near_copies import keep

    rng = random.Random(11)
    hub = words(rng, 400, 5000)
    texts = [changed(rng, hub, 7) for _ in range(60)] + [hub] + [words(rng, 300, 5000) for _ in range(20)]
    df = frame(spark, [(i, t, None, "a", None, 7, "x", 0.5, "k", 1, "h", None) for i, t in enumerate(texts)])
    want = sorted(set(brute(texts)))
    assert len(want) == 21
    for how in ({"block": 8}, {"block": 8, "most": 1}):
        assert sorted(r.doc_id for r in keep(df, **how).collect()) == want


def test_shared_members():
    import numpy as np

    from docgate.llm.near_copies import shared_members

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 6000)).astype(np.uint64)) for _ in range(12)]
    left, right = np.arange(5), np.arange(3, 12)
    assert shared_members(sets, left, right).tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]


def rows_made(spark, run):
    """What `run` returns, and the rows that joins and generators made meanwhile, in all queries."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    result = run()
    bus.waitUntilEmpty()
    total, found = 0, store.executionsList()
    for k in range(before, found.size()):
        values = store.executionMetrics(found.apply(k).executionId())
        nodes = store.planGraph(found.apply(k).executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() or "Generate" in node.name():
                metrics = node.metrics()
                for m in (metrics.apply(i) for i in range(metrics.size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return result, total


def test_rows_do_not_grow_with_the_square_of_a_group(spark):
    """Copies of one text, a few changed words or many: half of them like no other, though all meet."""
    from docgate.llm.near_copies import keep

    made = {}
    for n in (120, 360):
        rng = random.Random(5)
        base = words(rng, 150, 5000)
        texts = [changed(rng, base, 1 + i % 8) for i in range(n)]
        df = frame(spark, [(i, t, None, "a", None, 7, "x", 0.5, "k", 1, "h", None) for i, t in enumerate(texts)])
        kept, made[n] = rows_made(spark, lambda: sorted(r.doc_id for r in keep(df, block=8).select("doc_id").collect()))  # noqa: B023
        assert kept == sorted(set(brute(texts)))
        assert n // 3 < len(kept) < n
    print(made)
    assert made[360] < 4.5 * made[120]


def test_sets_at_the_threshold_share_a_first_member():
    import numpy as np

    from docgate.llm.near_copies import first_members

    rng = np.random.default_rng(7)
    usual, often = np.arange(40, dtype=np.uint64), rng.integers(2, 9, 40)
    links = 0
    for least in ((4, 5), (1, 2)):
        for _ in range(1500):
            x = rng.choice(60, rng.integers(1, 40), replace=False).astype(np.uint64)
            y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.choice(60, rng.integers(0, 5)).astype(np.uint64)]))
            x = np.unique(x)
            shared = len(np.intersect1d(x, y))
            if shared * least[1] >= len(np.union1d(x, y)) * least[0]:
                links += 1
                (a, most_a), (b, most_b) = first_members(x, usual, often, least), first_members(y, usual, often, least)
                assert any(m == k and len(y) <= p and len(x) <= q for m, p in zip(a, most_a, strict=True) for k, q in zip(b, most_b, strict=True))
    assert links > 500


def test_blocks_for_many_texts():
    """Rows to shuffle follow the number of blocks, which keep the recall at the threshold."""
    import math

    from docgate.llm.near_copies import LEAST, RECALL, differing, shape

    for count, most in ((200_000, 8), (12_500_000, 16)):
        width, blocks = shape(count)
        p = differing(LEAST)
        close = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(3))
        assert blocks <= most and 1 - (1 - close) ** blocks >= RECALL


def test_texts_that_share_words_meet():
    import numpy as np

    from docgate.llm.near_copies import meet

    rng = np.random.default_rng(4)
    for n, width, apart in ((150, 12, 60), (400, 9, 62), (90, 14, 128)):
        prefix, place = 3, 5
        start = np.uint64(place) ^ rng.choice(np.array([0, 0, 1, 2, 4], np.uint64), n)
        word = (start << np.uint64(width - prefix)) | rng.integers(0, 1 << (width - prefix), n).astype(np.uint64)
        check = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        ball = [{int(w)} | ({int(w) ^ (1 << k) for k in range(width - prefix)} if int(s) == place else set()) for w, s in zip(word & np.uint64((1 << (width - prefix)) - 1), start, strict=True)]
        up = list(range(n))
        for i in range(n):
            for j in range(i):
                if up[i] != up[j] and ball[i] & ball[j] and np.bitwise_count(check[i] ^ check[j]).sum() <= apart:
                    low, high = sorted((up[i], up[j]))
                    up = [low if x == high else x for x in up]
        node, root = meet(place, word, check, width, prefix, apart)
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {i: u for i, u in enumerate(up) if i != u}
        assert 10 < len(node) < n


def test_texts_of_overlapping_buckets_are_sent_once(spark, monkeypatch):
    """Changed copies of one text, no two of them near copies, share many members and so meet in many buckets."""
    from docgate.llm import near_copies

    rng = random.Random(13)
    base = words(rng, 400, 5000)
    texts = [changed(rng, base, 9) for _ in range(40)] + [changed(rng, base, 3)]
    df = frame(spark, [(i, t, None, "a", None, 7, "x", 0.5, "k", 1, "h", None) for i, t in enumerate(texts)])
    sent, compare = [], near_copies._in_blocks
    monkeypatch.setattr(near_copies, "_in_blocks", lambda dealt, *more: sent.append(dealt.count()) or compare(dealt, *more))
    assert sorted(r.doc_id for r in near_copies.keep(df).collect()) == sorted(set(brute(texts)))
    print(sent)
    assert 2 <= sent[0] <= len(texts)
