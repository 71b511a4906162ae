"""The driver queries of the training-data operators and the SQL twins of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import (
    centroids, chat_format, exact_dedup, fingerprint, html_extract, minhash, mixing, packing, quality, substring_dedup, suffix_dedup, warc, whitening,
)

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weights of labelled documents: 1 for good ones, 0.25 for bad ones."""
    return _table(spark, sf_dir, "labels").filter("quality is not null").select(
        "doc_id", F.when(F.col("quality") == 1, 1.0).otherwise(0.25).alias("quality_weight"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_strings(_table(spark, sf_dir, "documents")).drop("kept")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(_table(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000).drop("deviation_exact")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, size=64, seed=1).drop("centroid")


#: What both turns of the conversation that ``op13`` adds say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_format.chat_digests(chat_format.as_events(rows))


QUERIES = {f.__name__: f for f in (
    op1_minhash, op2_quality, op3_html_text, op4_fingerprints, op5_suffix_dedup, op6_mix_sources, op7_best_fit_packing, op8_warc, op9_substring_dedup, op10_exact_dedup,
    op11_whitening, op12_centroids, op13_chat_format)}

def _centroid_sql(rounds: int) -> str:
    """The clustering of op12, one pair of common table expressions a round."""
    nearest = """
        a{0} AS MATERIALIZED (
            SELECT vec_id, x, arg_min(k, (d, k)) AS cluster, min(d) AS distance
            FROM (SELECT vec_id, x, k, CAST(list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d FROM v CROSS JOIN c{0})
            GROUP BY vec_id, x)"""
    moved = """
        c{1} AS MATERIALIZED (
            SELECT k, coalesce(m.c, c{0}.c) AS c
            FROM c{0} LEFT JOIN (
                SELECT cluster, list(q ORDER BY i) AS c
                FROM (SELECT cluster, i, CAST(floor(sum(e) / count(*)) AS BIGINT) AS q
                      FROM (SELECT cluster, unnest(x) AS e, unnest(range(1, 65)) AS i FROM a{0}) GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = k)"""
    parts = [nearest.format(0)]
    for r in range(rounds):
        parts += [moved.format(r, r + 1), nearest.format(r + 1)]
    return """
        WITH v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, x AS c FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16),""" + ",".join(parts) + f"""
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON k = cluster"""


def _chat_sql() -> str:
    """Digests of the turns; the length of the formatted text from counts of backslashes and control strings."""
    found = lambda c: " + ".join(f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in ("\\", *chat_format.CONTROLS))
    marks = sum(map(len, (chat_format.TURN, chat_format.TEXT, chat_format.END)))
    return f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
        s AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS spoken,
                   coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss,
                   CAST(sum({marks} + length(role) + length(text) + {found('role')} + {found('text')}) AS BIGINT) AS formatted_chars
            FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM s"""


_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLE = {
    "op1_minhash": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS shingle
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT r.doc_id, l.b FROM reach r
            JOIN (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links) l ON l.a = r.other),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
        SELECT page_id, octet_length(encode(h)) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM k""",
    "op9_substring_dedup": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
        g AS (
            SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS words
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM w WHERE len(ws) > 12)),
        m AS (SELECT words, min(doc_id) AS first FROM g GROUP BY words),
        gone AS (
            SELECT DISTINCT doc_id, i
            FROM (SELECT doc_id, unnest(range(s, s + 13)) AS i FROM g JOIN m USING (words) WHERE first < doc_id)),
        u AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
        k AS (
            SELECT doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY u.i) FILTER (WHERE g.i IS NULL) AS kept
            FROM u LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k USING (doc_id)""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op12_centroids": _centroid_sql(3),
    "op13_chat_format": _chat_sql(),
}
