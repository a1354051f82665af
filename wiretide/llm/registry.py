"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, table
from .embedding_dedup import near_duplicates
from .fingerprints import fingerprint_documents
from .jaccard_join import jaccard_groups
from .lang_id import fit_languages, identify
from .lm_scoring import lm_scores
from .mixing import mix_sources
from .packing import pack_documents
from .periodic_runs import periodic_runs, run_digests, with_repeated_tails
from .quality import fit_quality, score_quality
from .ranked_search import ranked_search
from .token_counts import count_tokens
from .token_files import rewrite_and_digest
from .url_filter import filter_urls

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), limit=4096)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    found = identify(docs, fit_languages(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "repetitions", "taken")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 7) != 2)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite_and_digest(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_repeated_tails(table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_token_counts": op3_token_counts,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_packing": op5_packing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_ranked_search": op11_ranked_search,
    "op12_token_files": op12_token_files,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE = {
    "op9_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), coalesce(source, ''), '20')) AS key
            FROM documents),
        sources AS (
            SELECT source, sum(size)::DOUBLE AS s,
                   [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
            FROM sized GROUP BY source),
        ordered AS (
            SELECT *, row_number() OVER (ORDER BY s / w, source NULLS LAST) AS k FROM sources),
        levels AS (
            SELECT a.source, a.s, a.w, a.k,
                   (1.5 * (SELECT sum(s) FROM sources) - 2 * coalesce(sum(b.s) FILTER (b.k < a.k), 0))
                       / sum(b.w) FILTER (b.k >= a.k) AS level
            FROM ordered a, ordered b GROUP BY ALL),
        opened AS (SELECT min_by(level, k) AS level FROM levels WHERE level * w <= 2 * s),
        targets AS (
            SELECT source, s, least(2 * s, coalesce(opened.level * w, 2 * s)) AS target FROM levels, opened),
        placed AS (
            SELECT d.doc_id, d.size, t.s, t.target, CASE WHEN t.s > 0 THEN t.target / t.s ELSE 0 END AS epochs,
                   sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)
                       - d.size / 2 AS middle
            FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
        taken AS (
            SELECT *, (floor(epochs) + CASE WHEN middle < (epochs - floor(epochs)) * s AND size > 0 THEN 1 ELSE 0 END)::BIGINT AS repetitions
            FROM placed)
        SELECT doc_id, size, s::BIGINT AS source_size, target, repetitions, size * repetitions AS taken FROM taken""",
    "op11_ranked_search": r"""
        WITH folded AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        sizes AS (SELECT count(*) AS documents, sum(len(t))::BIGINT AS total FROM folded WHERE len(t) > 0),
        hits AS (
            SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM folded)
            WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (
            SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM hits, sizes GROUP BY term, documents),
        scored AS (
            SELECT item_id, doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // total))))::BIGINT AS score
            FROM asked JOIN hits USING (term) JOIN weights USING (term), sizes GROUP BY item_id, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
    "op13_periodic_runs": r"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   xor(list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT for c in string_split(coalesce(doc_id::VARCHAR, 'null'), '')],
                       lambda acc, x: list_reduce([xor(acc, x)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                                                  lambda b, z: xor(b >> 1, (b & 1) * 3988292384))), 4294967295) AS h
            FROM documents),
        placed AS (SELECT *, len(w) AS n, (h // 10) % len(w) AS a, (h // 10) % 8 AS k FROM split),
        texts AS (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
                THEN [w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + k)) END + 1] for i in range(n)]
                ELSE w END AS w
            FROM placed),
        words AS MATERIALIZED (
            SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM texts WHERE n > 0),
        alike AS (
            SELECT a.doc_id, a.i, b.i - a.i AS q FROM words a JOIN words b
            ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND (b.i - a.i) * 3 <= a.n),
        steps AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM alike),
        stretched AS (
            SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM steps GROUP BY doc_id, q, island
            HAVING count(*) + q >= greatest(24, 3 * q)),
        runs AS MATERIALIZED (
            SELECT doc_id, start, length, min(q) AS period FROM stretched GROUP BY doc_id, start, length),
        listed AS (
            SELECT doc_id, count(*) AS n_runs,
                   string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
            FROM runs GROUP BY doc_id),
        best AS (
            SELECT * FROM runs QUALIFY row_number() OVER (
                PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
        left_over AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words w
            WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length)
            GROUP BY doc_id)
        SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM texts t LEFT JOIN listed USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN left_over USING (doc_id)""",
    "op1_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        cut AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM parts),
        ruled AS (
            SELECT page_id, host, path,
                   CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                        WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                        WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
                        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule
            FROM cut)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op6_embedding_dedup": r"""
        WITH RECURSIVE vectors AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
        links AS MATERIALIZED (
            SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b
            ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach AS (
            SELECT vec_id AS x, vec_id AS y FROM embeddings
            UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.y AS component_id, e.vec_id = c.y AS kept
        FROM embeddings e
        JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) c ON c.x = e.vec_id
        LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = e.vec_id""",
    "op7_jaccard_join": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        shared AS MATERIALIZED (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (
            SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE c / (p.n + q.n - c) >= 0.8
            UNION ALL
            SELECT a.doc_id, b.doc_id FROM split a JOIN split b ON a.doc_id <> b.doc_id WHERE len(a.w) = 0 AND len(b.w) = 0),
        reach AS (
            SELECT doc_id AS x, doc_id AS y FROM split
            UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
        SELECT d.doc_id, min(d.doc_id) OVER (PARTITION BY d.t) AS copy_of, c.y AS group_id, coalesce(n.n, 0) AS n_links,
               d.doc_id = c.y AS kept
        FROM split d
        JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) c ON c.x = d.doc_id
        LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = d.doc_id""",
}
