"""The thirteen queries over the driver's tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audio, exponion, language, lines, mixing, ngram_join, packing, quality, repeats, toxicity, vectors, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_table(spark, sf_dir, "documents")).taken()


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(_table(spark, sf_dir, "documents")).drop("n_near")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.Join(_table(spark, sf_dir, "documents"), n=4, t="0.85").classes()


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.Repeats(_table(spark, sf_dir, "documents")).digest()


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.Near(_table(spark, sf_dir, "embeddings")).rows()


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: every embedding is played as a short melody, and these recordings are aligned: one row per recording."""
    made = audio.recordings(_table(spark, sf_dir, "embeddings"), "embedding")
    return audio.Alignments(made, "vec_id", "recording").rows()


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.Whitening(_table(spark, sf_dir, "embeddings")).digest()


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(_table(spark, sf_dir, "documents"))


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.Exponion(_table(spark, sf_dir, "embeddings")).digest().drop("scanned")


QUERIES = {
    "op11_whitening": op11_whitening,
    "op12_language": op12_language,
    "op13_exponion": op13_exponion,
    "op3_audio": op3_audio,
    "op9_embeddings": op9_embeddings,
    "op6_repeats": op6_repeats,
    "op7_warc": op7_warc,
    "op1_ngram_join": op1_ngram_join,
    "op10_line_dedup": op10_line_dedup,
    "op5_quality": op5_quality,
    "op4_toxicity": op4_toxicity,
    "op2_mixing": op2_mixing,
    "op8_packing": op8_packing,
}

def _clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """Every distance of every round, by definition."""
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, x FROM v ORDER BY sha256('1:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.vec_id, v.x, c.k, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v, c{r} AS c) GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT k, list(m ORDER BY i) AS x FROM (SELECT k, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM a{r}, range(1, 65) AS r(i) GROUP BY k, i) GROUP BY k)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} ON m{r}.k = c{r}.k)")
    return f"WITH {', '.join(parts)} SELECT vec_id, a{rounds}.k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a{rounds}.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = a{rounds}.k"


ORACLE_SQL: dict[str, str] = {
    "op13_exponion": _clustering_sql(),
    # Brute force; the graph search is approximate, and finds all links at the small scales.
    "op9_embeddings": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach AS (
    SELECT vec_id, vec_id AS seen FROM embeddings
    UNION
    SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.seen
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id) AS c
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) AS l ON l.a = c.vec_id
""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM d
""",
    # Every pair that shares a shingle is counted; components by reachability.
    "op1_ngram_join": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
s AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
    SELECT o.a, o.b
    FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) AS o
    JOIN n AS p ON p.doc_id = o.a JOIN n AS q ON q.doc_id = o.b
    WHERE 100 * c >= 85 * (p.n + q.n - c)
),
reach AS (
    SELECT doc_id, doc_id AS seen FROM documents
    UNION
    SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.seen
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id) AS c ON c.doc_id = d.doc_id
""",
    # Equal lines by grouping; lines at distance 1 by joining on an equal first or last half and deleting characters.
    "op10_line_dedup": r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (
    SELECT doc_id, p - 1 AS pos, parts[p] AS line, trim(parts[p], E' \t\r') AS s
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS p
          FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM docs WHERE text IS NOT NULL))
),
u AS (
    SELECT s, length(s) AS n, min((coalesce(doc_id, 9223372036854775807), pos)) AS first
    FROM l WHERE length(s) > 0 GROUP BY s
),
k AS (
    SELECT s, n, first, m, side, CASE side WHEN 'head' THEN left(s, m // 2) ELSE right(s, m // 2) END AS half
    FROM (SELECT *, unnest([n, n - 1]) AS m FROM u WHERE n >= 20), (VALUES ('head'), ('tail')) AS v(side)
),
near AS (
    SELECT DISTINCT a.s
    FROM k AS a JOIN k AS b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND a.s <> b.s AND b.first < a.first
    WHERE least(a.n, b.n) = a.m
      AND CASE WHEN a.n = b.n
               THEN len(list_filter(range(1, a.n + 1), lambda i: left(a.s, i - 1) || substr(a.s, i + 1) = left(b.s, i - 1) || substr(b.s, i + 1))) > 0
               WHEN a.n > b.n
               THEN len(list_filter(range(1, a.n + 1), lambda i: left(a.s, i - 1) || substr(a.s, i + 1) = b.s)) > 0
               ELSE len(list_filter(range(1, b.n + 1), lambda i: left(b.s, i - 1) || substr(b.s, i + 1) = a.s)) > 0 END
),
gone AS (
    SELECT l.doc_id, l.pos
    FROM l JOIN u ON l.s = u.s LEFT JOIN near ON near.s = l.s
    WHERE near.s IS NOT NULL OR (coalesce(l.doc_id, 9223372036854775807), l.pos) <> u.first
),
sums AS (
    SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
           coalesce(string_agg(CASE WHEN gone.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS kept
    FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos
    GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       length(coalesce(kept, '')) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents AS d LEFT JOIN sums ON d.doc_id = sums.doc_id
""",
}
