import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.cases import documents, frame, words

from docgate.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [(r[0], r[1]) for r in documents()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup(spark):
    from docgate.llm.exact_dedup import decide, keep

    for support in (0.001, 0.5):
        got = decide(frame(spark), support=support).collect()
        groups = {}
        for i, t in TEXTS:
            groups.setdefault(hashlib.sha256(lower(t).encode()).hexdigest(), []).append(i)
        assert len(got) == len(TEXTS)
        best = {h: max((i for i in g if i is not None), default=None) for h, g in groups.items()}
        assert all((r.keep_id, r.group_size) == (best[r.text_sha256], len(groups[r.text_sha256])) for r in got)
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(groups, 1))
    kept = keep(frame(spark))
    assert kept.columns == frame(spark).columns
    assert kept.count() == len(groups)
    assert decide(frame(spark, [])).count() == 0 and keep(frame(spark, [])).count() == 0


def test_simhash(spark):
    import xxhash

    from docgate.llm.simhash import classes, collide, keep

    def fp(text):
        w = WORD.findall(lower(text))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = [(i, fp(t)) for i, t in TEXTS]
    fps = sorted({f for _, f in want})
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, f in want:
        if i is not None:
            least[top(f)] = min(least.get(top(f), i), i)
    expected = Counter((i, format(f, "016x"), least.get(top(f))) for i, f in want)
    for most in (4_000_000, 5000, 1):  # at 1, every bucket is dealt out again down to single words
        assert Counter(tuple(r) for r in classes(frame(spark), most=most).collect()) == expected
    kept = keep(frame(spark))
    assert kept.columns == frame(spark).columns
    assert len({top(fp(r.text)) for r in kept.collect()}) == len({top(f) for f in fps})
    assert classes(frame(spark, [])).count() == 0
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    near = np.unique([base ^ np.uint64((1 << int(a)) | (1 << int(b))) for a, b in rng.integers(0, 50, (300, 2))])
    node, root = collide(int(base >> np.uint64(56)), near, 8, 2)
    assert len(node) == len(near) - 1 and len(set(root.tolist())) == 1


def test_substrings(spark):
    from docgate.llm.substrings import remove

    def brute(rows, n):
        own = [WORD.findall(t or "") for _, t in rows]
        seen = Counter(tuple(w[k : k + n]) for w in own for k in range(len(w) - n + 1))
        out = []
        for (i, _), w in zip(rows, own, strict=True):
            gone = [False] * len(w)
            for k in range(len(w) - n + 1):
                if seen[tuple(w[k : k + n])] > 1:
                    gone[k : k + n] = [True] * n
            out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
        return Counter(out)

    rng = random.Random(3)
    loops = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(60))) + " z" * rng.choice([0, 9, 40, 80])) for k in range(60)]
    for rows, n in ((TEXTS, 35), (loops, 35), (loops, 12)):
        df = frame(spark) if rows is TEXTS else spark.createDataFrame(rows, "doc_id long, text string")
        got = remove(df, length=n).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
        assert Counter(tuple(r) for r in got) == brute(rows, n)
    assert remove(frame(spark, [])).count() == 0


def test_secrets(spark):
    from docgate.llm.secrets import findings, report

    rules = (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))

    def brute(text):
        found = [(m.start(), k, m.end()) for k, r in enumerate(rules) for m in r.finditer(text or "") if len(m[2] if k == 0 else m[0]) >= (8, 16, 32)[k]]
        return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))

    rng = random.Random(4)
    bits = ["token", "PassWord", "=", ":", " ", '"', "'", "AKIA", "a", "0", "secret", "api_key", "😀", "ABCDEF0123", "deadbeef01" * 2, "\n", "x.y"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(50)))) for k in range(600)] + TEXTS
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, spans string")
    got = report(findings(df)).collect()
    assert Counter((r.doc_id, r.spans) for r in got) == Counter((i, brute(t)) for i, t in rows)
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in got)
    assert all([r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in r.spans.split(",")) for k in ("assign", "access", "hex")] for r in got)


def test_secret_ledger_is_incremental(spark, tmp_path):
    from docgate.llm.secrets import LEDGER, findings

    ledger = f"file://{tmp_path}/ledger"
    one = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "token=abcdefgh1"), (3, "x")], "doc_id long, text string")
    findings(one, ledger).collect()
    two = spark.createDataFrame([(9, "token=abcdefgh1"), (4, "new")], "doc_id long, text string")
    assert {r.doc_id: len(r.spans) for r in findings(two, ledger).collect()} == {9: 1, 4: 0}
    assert spark.read.schema(LEDGER).parquet(ledger).count() == 3
    findings(two, ledger, version="2").collect()
    assert spark.read.schema(LEDGER).parquet(ledger).count() == 5
    assert findings(frame(spark, []), ledger).count() == 0


ODD = ["", "Don't <|endoftext|>STOP<|startoftext|>", "ÀÉß µ²½ ﬁne İstanbul ΣΑΣ 日本 한국어 é", "\x00\x01\x1c\x85\xa0x", "a'sb's''s 12³ !!'t", "😀 zwj 👩‍👩", "x" * 3000, "<|endoftext|>" * 3]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("word_bpe_49k.json"))


def test_token_counts(spark, library):
    from docgate.llm.token_counts import count

    rng = random.Random(6)
    odd = ODD + ["".join(chr(rng.randrange(1, 256)) for _ in range(80)) for _ in range(200)]
    rows = [(1000 + k, t) for k, t in enumerate(odd)] + TEXTS
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    assert Counter(tuple(r) for r in count(df, tokenizer("word_bpe_49k.json"), block=2000).collect()) == want
    assert count(frame(spark, []), tokenizer("word_bpe_49k.json")).count() == 0


def test_packing(spark, library):
    from docgate.llm.packing import Room, pack

    rows = [(1000 + k, t) for k, t in enumerate(ODD)] + [r for r in {r[0]: r for r in TEXTS}.items() for r in [r[1]] if r[0] is not None]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int")
    got = pack(df, tokenizer("word_bpe_49k.json"), group=20).collect()
    want = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    back = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.length == len(r.ids) // 4 and zlib.crc32(r.ids) >= 0 and r.doc_tokens == len(want[r.doc_id])
        back[r.doc_id] = back.get(r.doc_id, b"") + bytes(r.ids)
    assert back == {i: ids.tobytes() for i, ids in want.items()}
    sequences = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 2048
    assert pack(frame(spark, []), tokenizer("word_bpe_49k.json")).count() == 0
    sizes = sorted((random.Random(2).randrange(1, 101) for _ in range(500)), reverse=True)
    room, bins = Room(100), []
    for s in sizes:  # against first fit by search
        k = next((k for k, free in enumerate(bins) if free >= s), len(bins))
        if k == len(bins):
            bins.append(100)
        assert room.place(s) == (k, 100 - bins[k])
        bins[k] -= s


def test_mixing(spark):
    from docgate.llm.mixing import mix, mixed

    got = mix(frame(spark)).collect()
    assert len(got) == len(TEXTS)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t in TEXTS)
    assert all(r.taken == r.copies * r.size and r.copies <= 2 for r in got)
    by = {}
    for r in got:
        s = by.setdefault(r.source_size, [r.target, 0])
        s[1] += r.taken
    total = sum(r.size for r in got)
    assert abs(sum(t for t, _ in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(t <= 2 * size + 1e-6 and abs(taken - t) <= 6001 for size, (t, taken) in by.items())
    assert Counter(tuple(r) for r in mix(frame(spark)).collect()) == Counter(tuple(r) for r in got)
    assert mixed(frame(spark)).columns == frame(spark).columns
    assert mix(frame(spark, [])).count() == 0


def test_toxicity(spark):
    from docgate.llm.toxicity import chain, fit, keep, score

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        own = words(rng, rng.randrange(20, 60)).split()
        for _ in range(4 * bad):
            own.insert(rng.randrange(len(own)), rng.choice(["vilexa", "vilexo", "rotten"]))
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(bad)))
    rows += [(None, None), (500, ""), (501, "vilexa vilexo rotten vilexa!"), (502, "w1 " * 9000)]
    docs = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, score double")
    known = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = fit(docs, known)
    got = {r.doc_id: r for r in score(docs, model).collect()}
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert got[501].predicted == 1 and got[500].predicted == got[502].predicted == got[None].predicted == 0
    text = rows[501 - 500 + 401][1]
    assert [text[s.start : s.stop] for s in got[501].spans] == ["vilexa", "vilexo", "rotten", "vilexa"]
    assert {r.doc_id for r in keep(docs, model).collect()} == {i for i, r in got.items() if not r.predicted}
    assert score(frame(spark, []), model).count() == 0
    flat = fit(docs, known.filter("toxic = 0"))
    assert len({r.score for r in score(docs, flat).collect()}) == 1
    # forward-backward in columns against a plain one
    r = np.random.default_rng(2)
    odds, begins = r.normal(size=333), r.random(333) < 0.1
    begins[0] = True
    step, start = r.random((2, 2)) + 0.1, r.random(2) + 0.1
    p, moves = chain(odds, begins, step, start, width=7)
    e = np.stack([np.ones(333), np.exp(odds)], axis=1)
    left, right = np.zeros((333, 2)), np.ones((333, 2))
    for t in range(333):
        left[t] = (start if begins[t] else left[t - 1] @ step) * e[t]
        left[t] /= left[t].sum()
    for t in range(331, -1, -1):
        right[t] = 1 if begins[t + 1] else step @ (e[t + 1] * right[t + 1])
        right[t] /= right[t].sum()
    q = left * right
    assert np.allclose(p, q[:, 1] / q.sum(axis=1)) and abs(moves.sum() - (~begins).sum()) < 1e-6
