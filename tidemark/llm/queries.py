"""The registered queries of this package: each operator on its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    anchors, chunks, collisions, harmonic, language, licenses, metric_tree, mixing, near_dup, packing, quality, repeats,
    whitening)
from tidemark.llm.shared import held_out, read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned from the labels of the rows not held out."""
    docs = read(spark, sf_dir, "documents")
    found = quality.score_quality(docs, read(spark, sf_dir, "labels"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat earlier chunks."""
    return chunks.describe_chunks(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin and place of every piece of every document."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over links of similarity 0.85 on 3-word shingles."""
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


def op5_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 greatest integer inner products of every 50th vector."""
    return metric_tree.top_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the rows not held out."""
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families named in every document."""
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_paragraphs", F.size("licences").alias("n_licences"), F.array_join(
        F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",").alias("families"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found of every 100th vector."""
    return collisions.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that repeat."""
    return repeats.describe_repeats(read(spark, sf_dir, "documents"), length=400)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by the mixture of all sources."""
    found, _ = mixing.mix(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op11_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document's tokens."""
    import public_tokenizers

    found = harmonic.pack_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 whitened components of every vector."""
    found = whitening.whiten(read(spark, sf_dir, "embeddings"), components=8, scale=1024, offset=100_000)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-part product codes of every vector, after two rounds of 64 entries a part."""
    return anchors.describe_codes(read(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_chunk_dedup, op3_packing, op4_near_dup, op5_top_products, op6_language, op7_licenses,
    op8_nearest, op9_repeats, op10_mixing, op11_harmonic, op12_whitening, op13_codes, pipeline)}

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql() -> str:
    """Rounds of k-means as they are defined: all distances of all parts to all entries."""
    steps = [f"""kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE {_USABLE}),
parts AS (
    SELECT r, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS s
    FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS (SELECT p, r - 1 AS e, s FROM parts WHERE r <= 64)"""]
    for i in range(3):
        steps.append(f"""far{i} AS (
    SELECT a.r, a.p, b.e, list_sum(list_transform(list_zip(a.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts a JOIN book{i} b USING (p)),
near{i} AS (SELECT r, p, CAST(min(d * 64 + e) AS BIGINT) AS best FROM far{i} GROUP BY r, p)""")
        if i < 2:
            steps.append(f"""sums{i} AS (
    SELECT p, n.best % 64 AS e, j, CAST(floor(CAST(sum(s[j]) AS DOUBLE) / count(*)) AS BIGINT) AS c
    FROM near{i} n JOIN parts USING (r, p), (SELECT unnest(range(1, (SELECT len(s) FROM parts LIMIT 1) + 1)) AS j)
    GROUP BY p, n.best % 64, j),
new{i} AS (SELECT p, e, list(c ORDER BY j) AS s FROM sums{i} GROUP BY p, e),
book{i + 1} AS (SELECT b.p, b.e, coalesce(n.s, b.s) AS s FROM book{i} b LEFT JOIN new{i} n ON b.p = n.p AND b.e = n.e)""")
    return f"""WITH {", ".join(steps)},
codes AS (
    SELECT r, string_agg(format('{{:02x}}', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error
    FROM near2 GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) AS h FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN codes USING (r), books"""


SQL: dict[str, str] = {
    "op5_top_products": f"""WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE {_USABLE}),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM kept q JOIN kept c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored)
SELECT * FROM ranked WHERE rank <= 5""",
    "op13_codes": _codes_sql(),
}
