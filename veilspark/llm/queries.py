"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_extract, language_id, lm_scoring, mixing, ngram_join, sharding, substring_dedup, topk_search


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op2_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.pack(_read(spark, sf_dir, "documents"), shards=8)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return bpe.Encoder(documents, bpe.default_path()).round_trip(documents)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), length=13, extend=False)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op6_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _read(spark, sf_dir, "embeddings")
    return topk_search.top_k(embeddings, F.col("vec_id") % 100 == 0, k=10)


def op7_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    found = language_id.identify(documents, documents.where(~F.col("held_out")))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict:
    return {f.__name__: f for f in (op1_template_extract, op2_bin_packing, op3_transducer_bpe, op4_substring_dedup, op5_ngram_jaccard_join, op6_uniform_threshold, op7_backoff_automaton, op8_exact_dedup, op9_language_id, op10_entropy_mixing)}


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


OP6_SQL = """
WITH v AS (
  SELECT vec_id, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
  GROUP BY 1, 2
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


_WORDS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p
  FROM (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents)
), g AS (
  SELECT doc_id, p, string_agg(word, ' ') OVER r AS gram, count(*) OVER r AS n
  FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING)
)"""

OP4_SQL = _WORDS_SQL.format(text="coalesce(text, '')", last=12) + """
, owner AS (
  SELECT gram, min(doc_id) AS least FROM g WHERE n = 13 GROUP BY gram
), gone AS (
  SELECT DISTINCT g.doc_id, g.p + k.k AS p
  FROM g JOIN owner USING (gram) CROSS JOIN (SELECT unnest(range(13)) AS k) k
  WHERE g.n = 13 AND owner.least < g.doc_id
), kept AS (
  SELECT w.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(w.word, ' ' ORDER BY w.p) FILTER (WHERE gone.p IS NULL) AS text
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.p = gone.p GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP5_SQL = _WORDS_SQL.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", last=4) + """
, s AS (
  SELECT DISTINCT doc_id, gram FROM g WHERE n = 5
  UNION
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) FROM w GROUP BY doc_id HAVING count(*) < 5
), size AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS joint FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * joint >= 80 * (x.n + y.n - joint)
), reach AS (
  SELECT a, b FROM link
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
), degree AS (
  SELECT a, count(*) AS n_links FROM link GROUP BY a
)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id, coalesce(degree.n_links, 0) AS n_links
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id LEFT JOIN degree ON degree.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": OP4_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op6_uniform_threshold": OP6_SQL, "op8_exact_dedup": OP8_SQL}
