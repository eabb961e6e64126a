"""The queries of this subpackage and, where SQL can say the same, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgate.llm.common import LOWER, UPPER, table


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgate.llm.exact_dedup import decide

    return decide(table(spark, sf_dir, "documents"))


def op9_simhash_neardedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgate.llm.simhash import classes

    return classes(table(spark, sf_dir, "documents"))


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgate.llm.packing import pack

    made = pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgate.llm.token_counts import count

    return count(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgate.llm.secrets import findings, report

    return report(findings(table(spark, sf_dir, "documents")))


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgate.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgate.llm.warc import read, write

    return read(write(table(spark, sf_dir, "pages"))).drop("payload")


def op1_embedding_neardedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgate.llm.embeddings import dedup

    return dedup(table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgate.llm.substrings import remove

    return remove(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgate.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("spans")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgate.llm.personal import find, report

    return report(find(table(spark, sf_dir, "documents")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgate.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgate.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_neardedup": op1_embedding_neardedup,
    "op2_pack_documents": op2_pack_documents,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_warc_index": op4_warc_index,
    "op5_token_counts": op5_token_counts,
    "op6_secret_ledger": op6_secret_ledger,
    "op7_fair_mix": op7_fair_mix,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_simhash_neardedup": op9_simhash_neardedup,
    "op10_toxicity_crf": op10_toxicity_crf,
    "op11_personal_data": op11_personal_data,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

def _secrets_sql() -> str:
    from docgate.llm.secrets import RULES

    kinds = " UNION ALL ".join(
        "SELECT doc_id, '{0}' AS kind, {1} AS rank, {2} AS least, regexp_extract_all(x, '{3}', 0) AS ms, regexp_extract_all(x, '{3}', {4}) AS js, string_split_regex(x, '{3}') AS ps FROM t".format(
            kind, rank, least, pattern.replace("'", "''"), group
        )
        for rank, (kind, pattern, group, least) in enumerate(RULES)
    )
    counts = ", ".join(f"coalesce(count_if(kind = '{kind}'), 0)::BIGINT AS n_{kind}" for kind, *_ in RULES)
    spans = "coalesce(string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, rank), '')"
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), m AS ({kinds}),
        e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM m),
        s AS (SELECT doc_id, kind, rank, least, len(ms[k]) AS size, len(js[k]) AS judged,
                     (list_sum(list_transform(list_slice(ps, 1, k), lambda y: len(y))) + coalesce(list_sum(list_transform(list_slice(ms, 1, k - 1), lambda y: len(y))), 0))::BIGINT AS a FROM e)
        SELECT t.doc_id, {counts}, sha256({spans}) AS base_sha256, {spans} AS spans
        FROM t LEFT JOIN (SELECT * FROM s WHERE judged >= least) f ON t.doc_id = f.doc_id GROUP BY t.doc_id"""


_SECRETS_SQL = _secrets_sql()

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op4_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS h FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM g""",
    "op7_fair_mix": r"""
        WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
        named AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_id, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM sizes),
        weighted AS (SELECT *, [5, 2, 1][(source_id - 1) % 3 + 1] AS weight FROM named),
        filled AS (SELECT *, (budget - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                          / sum(weight) OVER (ORDER BY source_size / weight, source_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
        marked AS (SELECT *, level * weight >= 2 * source_size AS is_full FROM filled),
        aims AS (SELECT source, source_id, source_size, budget,
                        CASE WHEN is_full THEN (2 * source_size)::DOUBLE
                             ELSE weight * first(level) OVER (ORDER BY is_full, source_size / weight, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS target FROM marked),
        offers AS (SELECT d.doc_id, d.size, a.source_id, a.source_size, a.target, a.budget, t.turn, md5('mix|' || t.turn || '|' || d.doc_id) AS key
                   FROM docs d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source CROSS JOIN (SELECT unnest([0, 1]) AS turn) t),
        timed AS (SELECT *, CASE WHEN target > 0 THEN sum(size) OVER (PARTITION BY source_id ORDER BY turn, key ROWS UNBOUNDED PRECEDING) / target ELSE 0 END AS finish FROM offers),
        queue AS (SELECT *, sum(size) OVER (ORDER BY finish, key ROWS UNBOUNDED PRECEDING) <= budget AS taken FROM timed)
        SELECT doc_id, size, source_size, target, sum(CASE WHEN taken THEN size ELSE 0 END)::BIGINT AS taken, count_if(taken)::BIGINT AS copies
        FROM queue GROUP BY doc_id, size, source_size, target""",
    "op1_embedding_neardedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT c.a AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n ON c.a = n.a""",
    "op6_secret_ledger": _SECRETS_SQL,
    "op8_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        k AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
        r AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM k JOIN r USING (h))),
        each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
        left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN left_over USING (doc_id)""",
}
