"""Queries on vectors: exact nearest neighbours and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.functions import vectors as V
from kinsieve.functions.text import person_text
from kinsieve.operators.embedding import HASH_A, HASH_B, HASH_P, HashedNGramEmbedder
from kinsieve.operators.knn import hit_rank, knn_join_blocks, recall_at_k

from . import fixture as X

K = 5


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries are the vectors whose id is divisible by 50, against all."""
    e = X.read(spark, sf_dir, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("position"), F.col("embedding").alias("vector"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("query_id", "position", F.round("blocking_score", 6).alias("blocking_score"), "rank")


def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(knn_join_blocks(*_sides(spark, sf_dir), K))


def knn_inner_product_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner product of vectors stretched by their label, without normalising."""
    e = X.read(spark, sf_dir, "embeddings").withColumn("v", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("label") % 3)))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("vector"))
    return _rounded(knn_join_blocks(q, e.select(F.col("vec_id").alias("position"), F.col("v").alias("vector")), K, normalize=False))


def knn_k_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k beyond the number of rows gives all rows; the queries are those of the largest ids divisible by 50."""
    q, r = _sides(spark, sf_dir)
    found = knn_join_blocks(q, r, 1_000_000)
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last_rank"))


def vector_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.read(spark, sf_dir, "embeddings").withColumn("v", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (F.col("vec_id") % 4) + F.lit(0.0)))
    u = V.normalize(F.col("v"))
    return e.select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(V.norm(u), 6).alias("unit_norm"), F.round(F.get(u, F.lit(0)), 6).alias("first"))


def knn_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are vectors moved a little; the hit is the vector itself."""
    e = X.read(spark, sf_dir, "embeddings")
    moved = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(i % 2 == 0, 0.12).otherwise(-0.12))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), moved.alias("vector"), F.col("vec_id").alias("true_position"))
    r = e.select(F.col("vec_id").alias("position"), F.col("embedding").alias("vector"))
    return recall_at_k(hit_rank(knn_join_blocks(q, r, 20), q), [1, 5, 10, 20]).select("k", F.round("recall", 6).alias("recall"))


def person_knn_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocking of person queries by hashed n-gram vectors of their text: each query divisible by 50 against all people."""
    emb = HashedNGramEmbedder(64)
    people = emb.with_vector(X.person(spark, sf_dir), person_text()).select("position", "vector")
    q = X.query(spark, sf_dir).where("query_id % 50 = 0")
    return _rounded(knn_join_blocks(emb.with_vector(q, person_text()).select("query_id", "vector"), people, 20))


#: Neighbours looked for, and the cosine of near duplicates.
NEAR_K, NEAR_COSINE = 10, 0.9
DOC_DIM = 256


def doc_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document divisible by 50 those of its nearest neighbours by hashed n-gram vectors of the whole text that reach the cosine, itself left out."""
    emb = HashedNGramEmbedder(DOC_DIM)
    docs = emb.with_vector(X.read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), F.col("text"))
    found = knn_join_blocks(docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector"), docs.select(F.col("doc_id").alias("position"), "vector"), NEAR_K)
    return _rounded(found.where((F.col("blocking_score") >= NEAR_COSINE) & (F.col("query_id") != F.col("position"))))


def doc_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, by a digest of the whole text."""
    d = X.read(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs")).where("n_docs > 1")


_UNIT = "list_cosine_similarity(q.embedding::double[], r.embedding::double[])"
_TOP = "select query_id, position, round(s, 6) as blocking_score, cast(rk as int) as rank from (select *, row_number() over (partition by query_id order by s desc, position) as rk from (select q.vec_id as query_id, r.vec_id as position, round({score}, 9) as s from e q cross join e r where q.vec_id % 50 = 0)) where rk <= {k}"


def _ngram_sql(rows: str, dim: int) -> str:
    """CTEs ``q`` and ``r`` (id, vector) of hashed n-grams of ``rows``, which gives (id, text, is_query, is_row)."""
    gram = "0::bigint"
    for k in range(3):
        gram = f"(({gram} * {HASH_A} + unicode(substr(t, i + {k}, 1))) % {HASH_P})"
    return f"""padded as (select id, is_query, is_row, ' ' || lower(coalesce(text, '')) || ' ' as t from ({rows})),
      grams as (select id, is_query, is_row, {gram} * {HASH_B} % {HASH_P} as h from (select *, unnest(range(1, greatest(length(t) - 1, 1))) as i from padded)),
      summed as (select id, is_query, is_row, h % {dim} as place, sum(case when h // {dim} % 2 = 1 then -1.0::double else 1.0::double end) as w from grams group by all),
      placed as (select p.id, p.is_query, p.is_row, place, coalesce(w, 0.0::double) as w from (select id, is_query, is_row, unnest(range({dim})) as place from padded) p left join summed using (id, is_query, is_row, place)),
      vectors as materialized (select id, is_query, is_row, list(w order by place) as v from placed group by id, is_query, is_row)"""


def _neighbours_sql(k: int, where: str = "") -> str:
    return f"""select query_id, position, round(s, 6) as blocking_score, cast(rk as int) as rank from (select *, row_number() over (partition by query_id order by s desc, position) as rk from
      (select q.id as query_id, r.id as position, round(list_cosine_similarity(q.v, r.v), 9) as s from vectors q cross join vectors r where q.is_query and r.is_row)) where rk <= {k}{where}"""


_PERSON_ROWS = f"select query_id as id, {X.TEXT_SQL} as text, true as is_query, false as is_row from query where query_id % 50 = 0 union all select position, {X.TEXT_SQL}, false, true from person"
_DOC_ROWS = "select doc_id as id, text, doc_id % 50 = 0 as is_query, true as is_row from documents where text is not null"

QUERIES = {f.__name__: f for f in (knn_cosine_topk, knn_inner_product_raw, knn_k_clamped, vector_l2_normalize, knn_recall_at_k, person_knn_blocking, doc_near_duplicates, doc_exact_duplicates)}
ORACLE_SQL = {
    "knn_cosine_topk": f"with e as (select vec_id, embedding from embeddings) {_TOP.format(score=_UNIT, k=K)}",
    "knn_inner_product_raw": "with e as (select vec_id, list_transform(embedding::double[], lambda x: x * (1 + label % 3)) as embedding from embeddings) "
    + _TOP.format(score="list_inner_product(q.embedding, r.embedding)", k=K),
    "knn_k_clamped": "select q.vec_id as query_id, count(*) as n, cast(count(*) as int) as last_rank from embeddings q cross join embeddings r where q.vec_id % 50 = 0 group by 1",
    "vector_l2_normalize": """with v as (select vec_id, list_transform(embedding::double[], lambda x: x * (vec_id % 4) + 0.0::double) as v from embeddings),
      n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from v)
      select vec_id, round(n, 6) as norm, case when n > 0 then round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) else 0.0 end as unit_norm,
        round(case when n > 0 then v[1] / n else v[1] end, 6) as first from n""",
    "knn_recall_at_k": """with q as (select vec_id, list_transform(embedding::double[], lambda x, i: x + case when (i - 1) % 2 = 0 then 0.12::double else -0.12::double end) as v from embeddings where vec_id % 50 = 0),
      s as (select q.vec_id as query_id, r.vec_id as position, round(list_cosine_similarity(q.v, r.embedding::double[]), 9) as s from q cross join embeddings r),
      k as (select *, row_number() over (partition by query_id order by s desc, position) as rk from s),
      h as (select query_id, min(case when position = query_id and rk <= 20 then rk end) as hit from k group by query_id),
      g as (select unnest([1, 5, 10, 20]) as k)
      select cast(k as int) as k, round(count(*) filter (where hit <= k) / count(*), 6) as recall from h cross join g group by k""",
    "person_knn_blocking": f"{X.BASE_SQL}, {_ngram_sql(_PERSON_ROWS, 64)} {_neighbours_sql(20)}",
    "doc_near_duplicates": f"with {_ngram_sql(_DOC_ROWS, DOC_DIM)} {_neighbours_sql(NEAR_K, f' and s >= {NEAR_COSINE} and query_id <> position')}",
    "doc_exact_duplicates": "select sha256(text) as digest, min(doc_id) as first_id, count(*) as n_docs from documents where text is not null group by 1 having count(*) > 1",
}
