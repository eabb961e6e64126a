"""Small tables with what operators must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, bucket string, score double, keep_id string, component_id int, text_sha256 string, copies string"


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def documents(seed=1):
    rng = random.Random(seed)
    shared = words(rng, 60)
    long = words(rng, 6000, 3000)
    texts = [None, "", "   \n", "One", "one", "ONE", "É", "é", shared, shared + " tail", "head " + shared, shared.upper(), long, long + " x", "a" * 5000]
    texts += [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    texts += [words(rng, 50) + " " + shared[:150] for _ in range(5)]
    texts += [t for t in texts[20:30]]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, "no id"), (None, None), (3, "One"), (3, "One"), (20, texts[20])]
    sources = ["b", "a", None, "ä", "c c"]
    return [(i, t, None, sources[k % 5], None, 7, "x", 0.5, "k", 1, "h", None) for k, (i, t) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
