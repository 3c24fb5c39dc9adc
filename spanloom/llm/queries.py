"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import byte_bpe, chat, exact_dedup, html_extract, packing, personal_data, quality, simhash, sort_means, token_store, topk, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_store(spark, sf_dir):
    return token_store.store_documents(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_html_extraction(spark, sf_dir):
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op7_quality(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_exact_top_k(spark, sf_dir):
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op9_exact_dedup(spark, sf_dir):
    rows = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_chat_formatting(spark, sf_dir):
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digest(spark, chat.write_examples(rows))


def op11_personal_data(spark, sf_dir):
    return personal_data.digest(personal_data.find(_table(spark, sf_dir, "documents")))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_sort_means(spark, sf_dir):
    return sort_means.cluster(_table(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (op1_best_fit_packing, op2_simhash_near_dedup, op3_token_store, op4_byte_bpe, op5_toxicity, op6_html_extraction, op7_quality, op8_exact_top_k, op9_exact_dedup, op10_chat_formatting)
QUERIES = {f.__name__: f for f in (*_ALL, op11_personal_data, op12_whitening, op13_sort_means, pipeline)}


def _sort_means_sql(clusters: int = sort_means.CLUSTERS, rounds: int = sort_means.ROUNDS) -> str:
    """The rounds written out: a<k> assigns to c<k>, c<k+1> are the means of a<k>."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (SELECT r, arg_min(k, d * {clusters} + k) AS k, min(d) AS d FROM (
             SELECT r, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM t, c{k}) GROUP BY r)""")
        steps.append(f"""m{k} AS (SELECT k, list(x ORDER BY i) AS c FROM (SELECT k, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
             FROM (SELECT k, unnest(v) AS x, unnest(range({sort_means.WIDTH})) AS i FROM t JOIN a{k} USING (r)) GROUP BY k, i) GROUP BY k),
         c{k + 1} AS (SELECT c{k}.k, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (k))""")
    last = f"a{rounds}"
    return f"""WITH t AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE len(embedding) = {sort_means.WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS (SELECT k - 1 AS k, v AS c FROM (SELECT v, row_number() OVER (ORDER BY sha256('{sort_means.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) AS k FROM t) WHERE k <= {clusters}),
        {", ".join(steps[:-1])},
        s AS (SELECT k, sum(d) AS s FROM {last} GROUP BY k)
        SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM {last}) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM {last} JOIN t USING (r) JOIN s USING (k) JOIN c{rounds} USING (k)"""


ORACLE_SQL = {
    "op13_sort_means": _sort_means_sql(),
    "op8_exact_top_k": """
        WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM t q JOIN t c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS x FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM t""",
    "op10_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        p AS (SELECT *, length(role) + length(text) + 14
                        + (length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')))
                        + (length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', ''))) AS n FROM c),
        o AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS e FROM p)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars,
               CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS n_examples,
               CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN e END), 0) AS BIGINT) AS example_chars
        FROM o GROUP BY conv_id""",
}
