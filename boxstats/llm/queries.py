"""Registered queries of the training-data operators and the equal SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxstats.llm import alignment, idfiles, jaccard, language, mixing, packing, prefixtrie, quality, sharding, suffixes, topk, toxicity, transducer


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(buckets: int):
    return F.crc32(F.col("doc_id").cast("string")) % buckets


def op1_id_files(spark, sf_dir):
    return idfiles.round_trip(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), _fold(5) != 0)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark, sf_dir):
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_top_k(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.filter("vec_id % 50 = 0"), rows, k=5)


def op6_suffix_dedup(spark, sf_dir):
    return suffixes.dedup(_table(spark, sf_dir, "documents")).drop("kept_text", "rest")


def op7_ngram_jaccard(spark, sf_dir):
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return transducer.token_counts(_table(spark, sf_dir, "documents"))


def op9_language(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    names, vectors = language.prototypes(docs.filter(_fold(4) != 2))
    found = language.predict(docs.select("doc_id", "text"), names, vectors)
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model)


def op11_alignment(spark, sf_dir):
    return alignment.align(_table(spark, sf_dir, "documents"))[0]


def op12_sharding(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    return prefixtrie.trie(_table(spark, sf_dir, "conversations"), prefixtrie.FAMILY)


_QUERIES = (
    op1_id_files, op2_toxicity, op3_best_fit_packing, op4_mix_sources, op5_exact_top_k, op6_suffix_dedup, op7_ngram_jaccard, op8_token_counts,
    op9_language, op10_quality_rules, op11_alignment, op12_sharding, op13_prefix_trie,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


# The crc32 of a conv_id in decimals, bit by bit, with its reversed polynomial.
_CRC32 = """(4294967295 - list_reduce(list_transform(string_split(o.conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda s, b: list_reduce(range(8), lambda t, i: xor(t >> 1, (t & 1) * 3988292384), xor(s, b)), 4294967295))"""
_WORD = r"[^\x20\x09-\x0D]+"


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mix_sources": rf"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
            md5(doc_id::VARCHAR || ':13') AS h FROM documents),
            s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
            w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM s),
            c AS (SELECT *, 1 + i % 3 AS weight, 3 * source_size AS cap FROM w),
            f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS remaining,
                sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights FROM c
                WINDOW o AS (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            g AS (SELECT remaining::DOUBLE / weights::DOUBLE AS share FROM f
                WHERE weight * (remaining::DOUBLE / weights::DOUBLE) <= cap ORDER BY cap / weight, i LIMIT 1),
            t AS (SELECT source, source_size, least(weight * share, cap::DOUBLE) AS target FROM f, g),
            r AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cum
                FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
            e AS (SELECT r.*, k, (k * source_size + cum)::DOUBLE / target AS vt FROM r, range(3) x(k) WHERE size > 0 AND target > 0),
            u AS (SELECT *, sum(size) OVER (ORDER BY vt, source IS NULL, source, h, doc_id, size, k
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e),
            n AS (SELECT doc_id, count(*) AS times FROM u WHERE upto <= (SELECT sum(size) FROM d) GROUP BY doc_id)
            SELECT r.doc_id, r.size, r.source_size, r.target, (r.size * coalesce(times, 0))::BIGINT AS taken
            FROM r LEFT JOIN n USING (doc_id)""",
        "op5_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
                FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
            r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op13_prefix_trie": rf"""WITH t AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS m,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
            o AS (SELECT conv_id, list(m ORDER BY pos) AS own FROM t GROUP BY conv_id),
            r AS (SELECT conv_id, CASE WHEN conv_id % 20 = 0 THEN own
                ELSE list_concat(coalesce(head[1:h], []), own[h + 1:]) END AS turns
                FROM (SELECT o.conv_id, o.own, b.own AS head, {_CRC32} & 3 AS h FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20)),
            p AS (SELECT conv_id, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM r, range(len(turns) + 1) x(d)),
            n AS (SELECT prefix, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM p GROUP BY prefix),
            k AS (SELECT *, CASE WHEN depth > 0 THEN prefix[1:depth - 1] END AS up,
                CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(prefix[depth].text, '{_WORD}')) ELSE 0 END AS own FROM n),
            c AS (SELECT a.prefix, count(b.prefix) AS n_children FROM k a LEFT JOIN k b ON b.up = a.prefix GROUP BY a.prefix),
            s AS (SELECT a.prefix, sum(b.own)::BIGINT AS saved_tokens, count(*) FILTER (e.n_children = 0) AS n_leaves
                FROM k a JOIN k b ON b.depth >= a.depth AND b.prefix[1:a.depth] = a.prefix JOIN c e ON e.prefix = b.prefix GROUP BY a.prefix)
            SELECT k.conv_id, k.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, k.n_convs, c.n_children, s.n_leaves, s.saved_tokens,
                sha256(k.ids) AS ends_sha256
            FROM k JOIN c USING (prefix) JOIN s USING (prefix) LEFT JOIN n u ON u.prefix = k.up""",
    }
