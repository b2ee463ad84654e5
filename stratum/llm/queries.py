"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import toxicity
    from stratum.llm.labels import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm.shared import new_folder
    from stratum.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), new_folder(spark, "token-files"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm.repeats import repeat_spans

    out = repeat_spans(table(spark, sf_dir, "documents"), 400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.size("passages").cast("long").alias("n_passages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm.sentencepiece_lattice import decode, encode

    out = decode(encode(table(spark, sf_dir, "documents"), fold="viterbi"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm.media import media_features, with_container

    out = media_features(with_container(table(spark, sf_dir, "documents")))
    first, last = F.element_at("keyframes", 1), F.element_at("keyframes", -1)
    feature = F.format_string("codec=%s duration=%d/%d samples=%d keyframes=%d first=%d-%d last=%d-%d", "codec", "duration", "time_scale", "n_samples", F.size("keyframes"), first["start"], first["end"], last["start"], last["end"])
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import quality
    from stratum.llm.labels import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm.conversations import repair

    return repair(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm.ranked import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import language
    from stratum.llm.labels import remainder

    docs = table(spark, sf_dir, "documents")
    out = language.predict(docs.select("doc_id", "text"), language.fit(docs.filter(remainder("doc_id", 5) != 0)))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_media_columns": op8_media_columns,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_ranked_search": op12_ranked_search,
    "op13_language_id": op13_language_id,
}
ORACLES: dict[str, str] = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op12_ranked_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents WHERE text IS NOT NULL
        ), b AS (
            SELECT row_number() OVER () AS i, item_id,
                   list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM benchmark WHERE text IS NOT NULL
        ), s AS (
            SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0
        ), q AS (
            SELECT i, item_id, unnest(t) AS term FROM b
        ), o AS (
            SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d
        ), f AS (
            SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY ALL
        ), w AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs
        ), x AS (
            SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
            FROM f JOIN q USING (term) JOIN w USING (term), s GROUP BY ALL
        )
        SELECT item_id, rank, doc_id, score FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM x WHERE score > 0
        ) WHERE rank <= 50
    """,
}
