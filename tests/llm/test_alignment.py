import hashlib
import random
from collections import Counter

from tests.llm.cases import documents, frame


def brute(rows):
    """doc_id and results of (id, text) rows, each text encoded whole and every pair of tokens compared by byte ranges."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in prints} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in prints)}
    made = []
    for i, text in rows:
        ids_a, ids_b = ([], []) if not text else (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
        of_a = [bytes(byte[c] for c in a.id_to_token(x)) for x in ids_a]
        of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x in ids_b for p in [b.id_to_piece(x)]]
        if not text or b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            made.append((i, [], []))
            continue
        ends_a, ends_b = ([sum(map(len, t[: k + 1])) for k in range(len(t))] if len(t) < 500 else list(__import__("itertools").accumulate(map(len, t))) for t in (of_a, of_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        group_a, group_b = ([next(k for k, c in enumerate(cuts) if e <= c) for e in ends] if len(ends) < 500 else __import__("numpy").searchsorted(cuts, ends).tolist() for ends in (ends_a, ends_b))
        parts = [([x for x, g in zip(ids_a, group_a) if g == k], [y for y, g in zip(ids_b, group_b) if g == k]) for k in range(len(cuts))] if len(cuts) < 500 else None
        if parts is None:
            parts = [([], []) for _ in cuts]
            for ids, group, side in ((ids_a, group_a, 0), (ids_b, group_b, 1)):
                for x, g in zip(ids, group):
                    parts[g][side].append(x)
        made.append((i, parts, [(x, y) for p, q in parts for x in p for y in q]))
    held = Counter(pair for _, _, links in made for pair in set(links))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    for i, parts, links in made:
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in parts)
        counts = [held[pair] for pair in links]
        yield i, sum(len(p) for p, _ in parts), sum(len(q) for _, q in parts), len(parts), len(links), sum(n == most[x] for n, (x, _) in zip(counts, links)), sum(counts), hashlib.sha256(said.encode()).hexdigest() if parts else ""


ODD = [
    " lead", "trail ", "two  gaps", "\n", " ", "a\nb", "a\n\nb", "a \n b", "tab\tx", "\r\nx", "<|endoftext|> <s>x</s>", "▁", "a▁b c", "don't I'll 'S", "日本語 テキスト", "é́ ﬁ ½", "😀 👩‍👩‍👧 x", "\x00 a\x1cb \x85 c", "a b 　c",
    "x" * 3000, "ab" * 900 + " 12345678901234567890", "{\n  }\r\n ;\r x", "end.\nStart \n\nNew ½\n", "\n a", " \na", "a\n", "​﻿x y",
]


def _rows(got):
    return Counter(tuple(r) for r in got.collect())


def test_against_brute_force(spark):
    from docgate.llm.alignment import align
    from docgate.llm.queries import tokenizer

    rng = random.Random(3)
    letters = "ab é\n\t .,'1▁日😀 \r<>s"
    fuzz = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    rows = [(r[0], r[1]) for r in documents()] + [(1000 + i, t) for i, t in enumerate(ODD + fuzz)]
    df = frame(spark, [(i, t, None, None, 1, 1, "at", 1.0, "k", 1, "h", None) for i, t in rows])
    paths = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    got = align(df.repartition(3), *paths, block=20_000)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = Counter(brute(rows))
    assert _rows(got) == want
    assert _rows(align(df.coalesce(1), *paths)) == want
    assert align(df.limit(0), *paths).count() == 0
    assert _rows(align(df.filter("text is null"), *paths)) == Counter(brute([r for r in rows if r[1] is None]))


def test_label_string():
    import numpy as np

    from docgate.llm.alignment import groups, labels

    label = labels(6, np.array([2, 3, 6]), np.array([1, 3, 6]))
    assert label == bytes([2, 1, 3, 0, 0, 3])
    assert groups(label) == [(2, 2), (1, 1)]


def test_query_on_a_whole_table(spark):
    from docgate.llm.common import table
    from docgate.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert _rows(QUERIES["op13_tokenizer_alignment"](spark, sf)) == Counter(brute([tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]))
