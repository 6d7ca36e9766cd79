"""One query per corpus operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from routeloom.llm import centroids, decontaminate, html_extract, manifest, merge_encode, near_dups, packing, pii, pivot_search, secret_scan, token_counts, toxicity, warc
from routeloom.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op5_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), size=3, pct=85)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("found")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents")).drop("found")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, corpus_pipeline.toxicity_model(docs, sf_dir), threshold=0.3)
    held = F.coalesce(corpus_pipeline.fold(F.col("row.doc_id")) == 2, F.lit(False))
    return scored.select("row.doc_id", held.alias("held_out"), "score", "predicted")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = merge_encode.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    both = merge_encode.decode(encoded.select("doc_id", "ids"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    def leaf(n_chars: Column) -> Column:
        return manifest.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaves = table(spark, sf_dir, "documents").select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(tampered, leaf(F.col("n_chars") + 1)).alias("altered"))
    proved = manifest.manifest(leaves, tree="lang", order="doc_id", leaf="leaf")
    folded = proved.withColumn("folded_root", manifest.folded(F.coalesce("altered", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
    clusters = centroids.cluster(table(spark, sf_dir, "embeddings"), hashed)
    return clusters.withColumn("centroid_sha256", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)).drop("centroid")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontaminate, op2_token_counts, op3_pack, op4_top_k, op5_extract_text, op6_near_duplicates, op7_secrets, op8_personal_data, op9_toxicity, op10_warc, op11_encode, op12_manifest, op13_centroids]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, {1 + 10 * g}, 10))::BIGINT >> {35 - 5 * i}) & 31)::INT, 1)" for g in range(4) for i in range(8)
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op4_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_near_duplicates": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), sh AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
        ), n AS (SELECT doc_id, len(s)::BIGINT AS n FROM sh), u AS (SELECT doc_id, unnest(s) AS x FROM sh),
        inter AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (
            SELECT p, q FROM inter JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q WHERE 100 * i >= 85 * (a.n + b.n - i)
        ), edge AS (SELECT p, q FROM link UNION ALL SELECT q, p FROM link),
        reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, edge.q FROM reach JOIN edge ON edge.p = reach.r)
        SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
        FROM n JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)""",
    "op10_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
        f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_B32} AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM p JOIN f USING (hex)""",
}


def _manifest_sql() -> str:
    """Levels by recursion; each leaf's siblings are the nodes beside its path."""

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"

    crc = "list_reduce([4294967295::UBIGINT] || list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::UBIGINT), lambda acc, b: list_reduce([xor(acc, b)] || [0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END))"
    return f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(lang, '') AS t, lang IS NULL AS nt, {leaf("n_chars")} AS leaf,
                CASE WHEN xor({crc}, 4294967295::UBIGINT) % 7 = 0 THEN {leaf("(n_chars + 1)")} END AS altered FROM documents
        ), l AS (
            SELECT *, row_number() OVER (PARTITION BY t, nt ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY t, nt) AS n FROM d
        ), node AS (
            SELECT t, nt, 0 AS level, pos, leaf AS h, n FROM l
            UNION ALL
            SELECT t, nt, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM node WHERE n > 1 GROUP BY t, nt, level, pos // 2, n
        ), sub AS (SELECT t, nt, level AS depth, h AS subroot, row_number() OVER (ORDER BY nt DESC, t) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
        top AS (
            SELECT 0 AS level, pos, subroot AS h, n FROM sub
            UNION ALL
            SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n
        ), leaves AS (SELECT l.*, s.subroot, s.depth, s.pos AS place, row_number() OVER () AS id FROM l JOIN sub s USING (t, nt)),
        steps AS (
            SELECT id, p.level, p.h, p.pos > l.pos >> p.level AS after FROM leaves l
                JOIN node p ON p.t = l.t AND p.nt = l.nt AND p.n > 1 AND p.pos = xor(l.pos >> p.level, 1)
            UNION ALL
            SELECT id, l.depth + p.level, p.h, p.pos > l.place >> p.level FROM leaves l JOIN top p ON p.n > 1 AND p.pos = xor(l.place >> p.level, 1)
        ), heights AS (SELECT max(level) AS top_depth FROM top),
        fold AS (
            SELECT id, 0 AS level, depth + top_depth AS levels, coalesce(altered, leaf) AS h FROM leaves CROSS JOIN heights
            UNION ALL
            SELECT f.id, f.level + 1, f.levels, sha256(CASE WHEN s.after IS NULL THEN f.h WHEN s.after THEN f.h || s.h ELSE s.h || f.h END)
            FROM fold f LEFT JOIN steps s ON s.id = f.id AND s.level = f.level WHERE f.level < f.levels
        ), proof AS (SELECT id, string_agg(h, '' ORDER BY level) AS p FROM steps GROUP BY id)
        SELECT l.doc_id, l.leaf, l.subroot, r.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
        FROM leaves l JOIN fold f ON f.id = l.id AND f.level = f.levels LEFT JOIN proof p ON p.id = l.id JOIN top r ON r.n = 1"""


def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """Distances in full every round; the last assignment follows the last move."""
    parts = [
        """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1)::INT AS j, e FROM v QUALIFY j < {k})",
    ]
    for r in range(rounds + 1):
        far = "list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e)"
        parts.append(f"a{r} AS MATERIALIZED (SELECT i, vec_id, e, min_by(j, (d, j)) AS j, min(d) AS d FROM (SELECT v.i, v.vec_id, v.e, c.j, {far} AS d FROM (SELECT *, row_number() OVER () AS i FROM v) v CROSS JOIN c{r} c) GROUP BY i, vec_id, e)")
        parts.append(f"m{r} AS (SELECT j, list(x ORDER BY p) AS e FROM (SELECT j, p, floor(sum(e[p]::BIGINT) / count(*)) AS x FROM a{r}, range(1, 65) t(p) GROUP BY j, p) GROUP BY j)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m USING (j))")
    last = f"""
        SELECT a.vec_id, a.j AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(list_transform(c.e, lambda x: x::BIGINT), ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c USING (j)"""
    return ", ".join(parts) + last


ORACLE_SQL |= {"op12_manifest": _manifest_sql(), "op13_centroids": _centroid_sql()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
