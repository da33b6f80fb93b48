"""Registered queries of this package and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.llm import (
    ann,
    conversation_repair,
    decontaminate,
    html_text,
    langid,
    lexical_search,
    minhash_join,
    mixing,
    quality,
    sharding,
    token_counts,
    token_files,
    toxicity,
)
from mediafold.llm.common import documents, held_out
from mediafold.sources.tables import load


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by an additive model with pairwise interactions."""
    return quality.quality_scores(documents(spark, sf_dir), load(spark, sf_dir, "labels"),
                                  lambda c: held_out(c, 4, 2), threshold=0.7)


def op2_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest vectors of every query (id divisible by 20) by a hierarchical k-means tree."""
    return ann.search(load(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0, k=20)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by smoothed text-to-tag ratios."""
    return html_text.extract_pages(load(spark, sf_dir, "pages"))


def op4_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the nearest of several centroids per language."""
    return langid.predict_languages(documents(spark, sf_dir), lambda c: held_out(c, 3, 1))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts tokenised, written as token files in doc_id order and read back."""
    import public_tokenizers
    return token_files.token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at five-word Jaccard similarity of 0.8 or more."""
    return minhash_join.jaccard_classes(documents(spark, sf_dir), threshold=0.8).select(
        "doc_id", "class_id", "copy_id", "n_copies", "n_links")


def op7_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document by FM-indexes of shards of the corpus."""
    return decontaminate.contamination(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"), window=10)


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 40 shards of near equal bytes by a k-d tree."""
    return sharding.kd_shards(documents(spark, sf_dir), n_shards=40)


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in an order in which every source follows its target weight."""
    return mixing.pfair_mix(documents(spark, sf_dir))


def op10_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a convolutional text classifier."""
    return toxicity.toxicity_scores(documents(spark, sf_dir), load(spark, sf_dir, "labels"),
                                    lambda c: held_out(c, 5, 0), threshold=0.5)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document by broadcast lengths of frequent pre-tokens and worker caches."""
    import public_tokenizers
    counts = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation by branch and bound."""
    rows = conversation_repair.damaged(load(spark, sf_dir, "conversations"))
    return conversation_repair.repair_digests(rows, conversation_repair.plan(rows))


def op13_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item by exact search in ball trees."""
    return lexical_search.ranked_search(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"), k=50)


QUERIES = {f.__name__: f for f in (
    op1_quality_gam, op2_kmeans_tree_search, op3_html_text, op4_centroid_langid, op5_token_files, op6_jaccard_join,
    op7_fm_decontaminate, op8_kd_shards, op9_pfair_mix, op10_toxicity_cnn, op11_token_counts,
    op12_conversation_repair, op13_ball_tree_search)}

OP7_SQL = """
WITH dw AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
         lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM documents),
bw AS (
  SELECT item_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
         lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + 9), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
pos AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, k, item_id FROM pos JOIN win USING (k, g)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6_SQL = """
WITH RECURSIVE dw AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
         lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM documents),
reps AS (SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, min(doc_id) AS rep, count(*) AS n FROM dw
         WHERE len(w) > 0 GROUP BY 1),
grams AS (SELECT DISTINCT rep, array_to_string(list_slice(w, i, i + 4), ' ') AS g
          FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM reps)),
sizes AS (SELECT rep, count(*) AS c FROM grams GROUP BY rep),
pairs AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.rep < b.rep GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes s ON s.rep = x JOIN sizes t ON t.rep = y
          WHERE pairs.c >= 0.8 * (s.c + t.c - pairs.c) - 1e-9),
either AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT rep, rep FROM reps UNION SELECT reach.a, either.y FROM reach JOIN either ON reach.b = either.x),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
degree AS (SELECT x, count(*) AS n FROM either GROUP BY x)
SELECT dw.doc_id, coalesce(roots.root, dw.doc_id) AS class_id, coalesce(reps.rep, dw.doc_id) AS copy_id,
       CAST(coalesce(reps.n, 1) AS BIGINT) AS n_copies, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links
FROM dw LEFT JOIN reps ON len(dw.w) > 0 AND array_to_string(dw.w, ' ') = reps.k
LEFT JOIN roots ON roots.a = reps.rep LEFT JOIN degree ON degree.x = reps.rep
"""

OP13_SQL = """
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, list_transform(
    regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
    lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM documents),
bt AS (
  SELECT DISTINCT item_id, unnest(list_transform(
    regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
    lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t
  FROM benchmark),
sums AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS nw FROM dw WHERE len(w) > 0),
tfs AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM dw) WHERE t IN (SELECT t FROM bt) GROUP BY r, t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS wt
       FROM (SELECT t, count(*) AS df FROM tfs GROUP BY t), sums),
x AS (SELECT r, t, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * nd) // nw)) AS x
      FROM tfs JOIN dw USING (r), sums),
s AS (SELECT item_id, r, CAST(sum(wt * x) AS BIGINT) AS score FROM bt JOIN wt USING (t) JOIN x USING (t) GROUP BY item_id, r),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
           FROM s JOIN dw USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

ORACLE: dict[str, str] = {"op6_jaccard_join": OP6_SQL, "op7_fm_decontaminate": OP7_SQL, "op13_ball_tree_search": OP13_SQL}
