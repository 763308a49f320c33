"""The registered queries over the `embeddings`, `documents` and `events` tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import VectorError
from nearfield.functions import distances as D
from nearfield.functions import registry
from nearfield.operators import search
from nearfield.operators.ann import CellIndex, Config, Index
from nearfield.operators.filters import Filter
from nearfield.operators.index import ThreadSafeIndex, VectorIndex, repeated_ids, validate
from nearfield.operators.metadata import Schema
from nearfield.operators.positions import with_positions
from nearfield.plans import bench_stats
from nearfield.plans.monitor import latency_stats
from nearfield.plans.stable import shared_folder
from nearfield.streaming.ingest import latency_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Searches take as queries every row whose id is divisible by this.
STEP, K = 20, 10


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, label). A table of a single file is one task, so it is dealt out to all cores first."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def some_queries(rows: DataFrame) -> DataFrame:
    """The stated query set."""
    return rows.where(F.col("id") % STEP == 0).select(F.col("id").alias("q_id"), F.col("vector").alias("q"))


def all_queries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("q_id"), F.col("vector").alias("q"))


stated_queries = some_queries


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", F.round("dist", 6))


# SQL parts

CORPUS_SQL = "corpus AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"


def _list(expression: str) -> str:
    return f"list_sum(list_transform(range(1, len(v) + 1), lambda i: {expression}))"


DIST_SQL = {
    "euclidean": f"sqrt({_list('(v[i] - q[i]) * (v[i] - q[i])')})",
    "sqeuclidean": _list("(v[i] - q[i]) * (v[i] - q[i])"),
    "cosine": f"greatest(0.0, 1 - {_list('v[i] * q[i]')} / sqrt({_list('v[i] * v[i]')} * {_list('q[i] * q[i]')}))",
    "manhattan": _list("abs(v[i] - q[i])"),
    "chebyshev": "list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - q[i])))",
    "minkowski3": f"pow({_list('pow(abs(v[i] - q[i]), 3.0)')}, 1.0 / 3.0)",
    "hamming": _list("CASE WHEN abs(v[i] - q[i]) > 1e-5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
    "jaccard": f"CASE WHEN {_list('CASE WHEN v[i] > 0.5 OR q[i] > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END')} = 0 THEN 0.0 ELSE 1 - {_list('CASE WHEN v[i] > 0.5 AND q[i] > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END')} / {_list('CASE WHEN v[i] > 0.5 OR q[i] > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END')} END",
    "angular": f"acos(greatest(-1.0, least(1.0, {_list('v[i] * q[i]')} / sqrt({_list('v[i] * v[i]')} * {_list('q[i] * q[i]')}))))",
    "canberra": _list("CASE WHEN abs(v[i]) + abs(q[i]) > 0 THEN abs(v[i] - q[i]) / (abs(v[i]) + abs(q[i])) ELSE 0.0::DOUBLE END"),
    "l15": f"pow({_list('pow(abs(v[i] - q[i]), 1.5)')}, 1.0 / 1.5)",
    # The inverse covariance has 0.75 on its diagonal and -0.25 beside it.
    "mahalanobis": f"sqrt(greatest(0.0, {_list('0.75 * (v[i] - q[i]) * (v[i] - q[i]) - 0.25 * (v[i] - q[i]) * (CASE WHEN i > 1 THEN v[i - 1] - q[i - 1] ELSE 0.0 END) - 0.25 * (v[i] - q[i]) * (CASE WHEN i < len(v) THEN v[i + 1] - q[i + 1] ELSE 0.0 END)')}))",
    "weighted": f"sqrt({_list('i * (v[i] - q[i]) * (v[i] - q[i])')})",
}


def knn_sql(dist: str = "euclidean", where: str = "true", k: int = K, rows: str = CORPUS_SQL, joins: str = "") -> str:
    return f"""WITH {rows}, queries AS (SELECT id AS q_id, v AS q FROM corpus WHERE id % {STEP} = 0),
pairs AS (SELECT q_id, c.id, {DIST_SQL[dist]} AS dist FROM corpus c {joins} CROSS JOIN queries WHERE {where}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY dist, id) AS INTEGER) AS rank FROM pairs)
SELECT q_id, rank, id, round(dist, 6) AS dist FROM ranked WHERE rank <= {k}"""


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# Distances: batch and single searches with each metric. Unit vectors rank alike under several metrics, so vectors are
# scaled by their label, and made binary for Jaccard.

SCALED_SQL = "corpus AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (1 + label)) AS v, label FROM embeddings)"
BINARY_SQL = "corpus AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v, label FROM embeddings)"


def scaled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vector", F.transform(F.col("vector").cast("array<double>"), lambda x: x * (1 + F.col("label"))))


def binary(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vector", F.transform("vector", lambda x: F.when(x > 0, 1.0).otherwise(0.0)))


def _metric_queries(name: str, m: D.Metric, shape, rows_sql: str) -> None:
    def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = shape(corpus(spark, sf_dir))
        return rounded(search.nearest_batch(rows, some_queries(rows), K, m))

    def single(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = shape(corpus(spark, sf_dir))
        return rounded(search.nearest(rows, rows.where("id = 7").first().vector, K, m))

    register(f"knn_batch_{name}", knn_sql(name, rows=rows_sql))(batch)
    register(f"knn_single_{name}", f"WITH {rows_sql}, one AS (SELECT v AS q FROM corpus WHERE id = 7), d AS (SELECT c.id, {DIST_SQL[name]} AS dist FROM corpus c CROSS JOIN one) SELECT id, round(dist, 6) AS dist FROM d ORDER BY d.dist, id LIMIT {K}")(single)


for _name in ("euclidean", "sqeuclidean", "cosine", "manhattan", "chebyshev", "hamming", "angular", "canberra"):
    _metric_queries(_name, D.Metric(_name), scaled, SCALED_SQL)
_metric_queries("minkowski3", D.Metric("minkowski", 3), scaled, SCALED_SQL)
_metric_queries("jaccard", D.Metric("jaccard"), binary, BINARY_SQL)


@register("knn_expression_euclidean", knn_sql())
def knn_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    return rounded(search.nearest_by_expression(rows, some_queries(rows), K))


@register("knn_sql_function", f"WITH {CORPUS_SQL}, one AS (SELECT v AS q FROM corpus WHERE id = 3), d AS (SELECT c.id, {DIST_SQL['manhattan']} AS dist FROM corpus c CROSS JOIN one) SELECT id, round(dist, 6) AS dist FROM d ORDER BY d.dist, id LIMIT 5")
def knn_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    D.register_sql(spark)
    corpus(spark, sf_dir).createOrReplaceTempView("nearfield_corpus")
    one = "(SELECT max(vector) FROM nearfield_corpus WHERE id = 3)"
    return spark.sql(f"SELECT id, round(dist, 6) AS dist FROM (SELECT id, vector_manhattan(vector, {one}) AS dist FROM nearfield_corpus) ORDER BY dist, id LIMIT 5")


_SQL_METRICS = ("euclidean", "sqeuclidean", "cosine", "manhattan", "chebyshev", "hamming", "jaccard", "angular", "canberra")


@register("sql_functions", f"WITH {CORPUS_SQL}, one AS (SELECT v AS q FROM corpus WHERE id = 3) SELECT c.id, {', '.join(f'round({DIST_SQL[m]}, 6) AS {m}' for m in _SQL_METRICS)}, round({DIST_SQL['minkowski3']}, 6) AS minkowski FROM corpus c CROSS JOIN one")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distance as a function of SQL, of every vector from one."""
    D.register_sql(spark)
    corpus(spark, sf_dir).createOrReplaceTempView("nearfield_corpus")
    one = "(SELECT max(vector) FROM nearfield_corpus WHERE id = 3)"
    each = ", ".join(f"round(vector_{m}(vector, {one}), 6) AS {m}" for m in _SQL_METRICS)
    return spark.sql(f"SELECT id, {each}, round(vector_minkowski(vector, {one}, 3D), 6) AS minkowski FROM nearfield_corpus")


@register("knn_k_exceeds_n", f"WITH {CORPUS_SQL}, one AS (SELECT v AS q FROM corpus WHERE id = 7) SELECT c.id, round({DIST_SQL['euclidean']}, 6) AS dist FROM corpus c CROSS JOIN one")
def knn_k_exceeds_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query for more rows than there are, which gives them all."""
    rows = corpus(spark, sf_dir)
    return rounded(search.nearest(rows, rows.where("id = 7").first().vector, 2**31 - 1))


@register("knn_sharded_merge", knn_sql())
def knn_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    return rounded(search.nearest_sharded(with_positions(rows, "id"), some_queries(rows), K, 4))


@register("shard_sizes", "WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings) SELECT CAST(least(pos // (n // 7), 6) AS INTEGER) AS shard, count(*) AS rows FROM p GROUP BY 1")
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.shards(with_positions(corpus(spark, sf_dir), "id"), 7).groupBy("shard").agg(F.count("*").alias("rows"))


@register("pairwise_l2", f"WITH {CORPUS_SQL}, queries AS (SELECT id AS q_id, v AS q FROM corpus WHERE id % {STEP} = 0) SELECT q_id, c.id, round({DIST_SQL['euclidean']}, 6) AS dist FROM corpus c CROSS JOIN queries")
def pairwise_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    return rounded(search.pairwise(some_queries(rows), rows))


# Scalar functions


@register("vector_norms", f"WITH {CORPUS_SQL} SELECT id, round({_list('v[i] * v[i]')}, 6) AS sq_norm, round(sqrt({_list('v[i] * v[i]')}), 6) AS magnitude FROM corpus")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("id", F.round(D.squared_norm(F.col("vector")), 6).alias("sq_norm"), F.round(D.magnitude(F.col("vector")), 6).alias("magnitude"))


@register("dot_products", f"WITH {CORPUS_SQL}, one AS (SELECT v AS q FROM corpus WHERE id = 0) SELECT c.id, round({_list('v[i] * q[i]')}, 6) AS dot FROM corpus c CROSS JOIN one")
def dot_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    q = search.vector_literal(rows.where("id = 0").first().vector)
    return rows.select("id", F.round(D.dot(D.doubles(F.col("vector")), q), 6).alias("dot"))


INT8_SQL = "trunc(greatest(-128.0, least(127.0, x::DOUBLE * 127)))"


@register("quantise_int8", f"SELECT vec_id AS id, CAST(list_sum(list_transform(embedding, lambda x: CAST({INT8_SQL} AS BIGINT))) AS BIGINT) AS total, CAST(list_min(list_transform(embedding, lambda x: {INT8_SQL})) AS BIGINT) AS least, CAST(list_max(list_transform(embedding, lambda x: {INT8_SQL})) AS BIGINT) AS most FROM embeddings")
def quantise_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform(D.to_int8(F.col("vector")), lambda x: x.cast("long"))
    return corpus(spark, sf_dir).select("id", F.aggregate(whole, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_min(whole).alias("least"), F.array_max(whole).alias("most"))


@register("knn_int8", knn_sql("sqeuclidean", rows=f"corpus AS (SELECT vec_id AS id, list_transform(embedding, lambda x: {INT8_SQL} / 127) AS v, label FROM embeddings)"))
def knn_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).withColumn("vector", D.from_int8(D.to_int8(F.col("vector"))))
    return rounded(search.nearest_batch(rows, some_queries(rows), K, "sqeuclidean"))


#: Rounding to half precision: to even, at the spacing of the number's power of two, which is 2^-24 below 2^-14.
HALF_SQL = "CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE round_even(x::DOUBLE / pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10) END"


@register("knn_half", knn_sql(rows=f"corpus AS (SELECT vec_id AS id, list_transform(embedding, lambda x: {HALF_SQL}) AS v, label FROM embeddings)"))
def knn_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).withColumn("vector", D.to_half(F.col("vector")))
    return rounded(search.nearest_batch(rows, some_queries(rows), K))


# Filters


def _filter_query(name: str, make: Callable[[], Filter], where: str, rows_sql: str = CORPUS_SQL, joins: str = "", table=None) -> None:
    @register(f"knn_filter_{name}", knn_sql(where=where, rows=rows_sql, joins=joins))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = corpus(spark, sf_dir)
        return rounded(search.nearest_batch(make().apply((table or (lambda r, *_: r))(rows, spark, sf_dir)), some_queries(rows), K))


def _with_metadata(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return rows.join(docs, "id", "left").withColumn("lang", F.coalesce("lang", F.lit(""))).withColumn("source", F.coalesce("source", F.lit(""))).withColumn("n_chars", F.coalesce("n_chars", F.lit(0))).withColumn("tags", F.array("lang", "source"))


_META = "LEFT JOIN documents d ON d.doc_id = c.id"
_filter_query("id_range", lambda: Filter.id_range(100, 300), "c.id BETWEEN 100 AND 300")
_filter_query("id_set", lambda: Filter.id_set(range(0, 400, 7)), "c.id < 400 AND c.id % 7 = 0")
_filter_query("id_set_joined", lambda: Filter.id_set(range(0, 4000, 3)), "c.id < 4000 AND c.id % 3 = 0")
_filter_query("boolean", lambda: Filter.boolean([i % 2 == 0 for i in range(300)]), "c.id IN (SELECT id FROM (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) WHERE pos < 300 AND pos % 2 = 0)", table=lambda rows, *_: with_positions(rows, "id"))
_filter_query("and", lambda: Filter.id_range(50, 350) & Filter.equals("label", 3), "c.id BETWEEN 50 AND 350 AND c.label = 3")
_filter_query("or", lambda: Filter.id_range(0, 30) | Filter.equals("label", 3), "c.id BETWEEN 0 AND 30 OR c.label = 3")
_filter_query("not", lambda: ~Filter.id_range(5, 450), "NOT c.id BETWEEN 5 AND 450")
_filter_query("compound", lambda: Filter.compound([Filter.id_range(13, 20), Filter.id_set([10, 11])]), "c.id BETWEEN 13 AND 20 OR c.id IN (10, 11)")
_filter_query("callback", lambda: Filter.callback(lambda i: i % 5 == 2), "c.id % 5 = 2")
_filter_query("equals", lambda: Filter.equals("label", 4), "c.label = 4")
_filter_query("gt", lambda: Filter.gt("label", 6), "c.label > 6")
_filter_query("lt", lambda: Filter.lt("label", 2), "c.label < 2")
_filter_query("predicate", lambda: Filter.predicate('lang == "en" AND n_chars > 500'), "d.lang = 'en' AND d.n_chars > 500", joins=_META, table=_with_metadata)
_filter_query("tags", lambda: Filter.predicate("array_contains(tags, 'src3') OR NOT label IN (1, 2, 3)"), "coalesce(d.source, '') = 'src3' OR NOT c.label IN (1, 2, 3)", joins=_META, table=_with_metadata)


# The index: ingest, changes and what it tells about itself


def _index(spark: SparkSession, sf_dir: str, where: str = "true") -> VectorIndex:
    return VectorIndex(spark, 64).add(corpus(spark, sf_dir).where(where).select("id", "vector"))


@register("knn_after_remove", knn_sql(where="NOT c.id IN (0, 1, 2, 11, 14) AND c.id % 10 <> 3"))
def knn_after_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, index = corpus(spark, sf_dir), _index(spark, sf_dir)
    index.remove([0, 1, 2, 11, 14, 10**9])
    index.remove(rows.where("id % 10 = 3").select("id"))
    return rounded(index.search_batch(some_queries(rows), K))


@register("knn_after_update", knn_sql(rows="base AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings), corpus AS (SELECT id, v, label FROM base WHERE id <> 20 UNION ALL SELECT 20, v, label FROM base WHERE id = 5)"))
def knn_after_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, index = corpus(spark, sf_dir), _index(spark, sf_dir)
    index.update(20, rows.where("id = 5").first().vector)
    return rounded(index.search_batch(some_queries(index.rows()), K))


@register("knn_after_compact", "SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings WHERE vec_id % 4 <> 0")
def knn_after_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    index.remove(corpus(spark, sf_dir).where("id % 4 = 0").select("id"))
    index.compact()
    return index.rows().select("id", "pos")


@register("knn_positions", f"WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id >= 100), one AS (SELECT v AS q FROM p WHERE vec_id = 150), d AS (SELECT pos, {DIST_SQL['euclidean']} AS dist FROM p CROSS JOIN one) SELECT pos, round(dist, 6) AS dist FROM d ORDER BY d.dist, pos LIMIT 10")
def knn_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir, "id >= 100")
    return rounded(index.search_positions(corpus(spark, sf_dir).where("id = 150").first().vector, K))


@register("index_info", "SELECT 64 AS dim, count(*) AS capacity, count(*) - 3 AS size, 3 AS deleted, 2 AS version FROM embeddings")
def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    index.remove([1, 2, 3])
    return spark.createDataFrame([(index.dim, index.capacity, len(index), index.deleted_count, index.version)], "dim int, capacity long, size long, deleted long, version long")


@register("validate_report", "SELECT 'duplicate ids' AS issue, count(*) AS n FROM (SELECT label FROM embeddings GROUP BY label HAVING count(*) > 1) UNION ALL SELECT 'wrong dimensions', count(*) FILTER (vec_id % 50 = 0) FROM embeddings UNION ALL SELECT 'wrong norms', count(*) FILTER (vec_id % 30 = 0 OR vec_id % 50 = 0) FROM embeddings")
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over rows made faulty on purpose: labels as ids, lengths cut, norms raised."""
    rows = corpus(spark, sf_dir).withColumn("sq_norm", D.squared_norm(F.col("vector")) + F.when(F.col("id") % 30 == 0, 1.0).otherwise(0.0))
    cut = rows.withColumn("vector", F.when(F.col("id") % 50 == 0, F.slice("vector", 1, 8)).otherwise(F.col("vector")))
    return validate(cut.withColumn("id", F.col("label")), 64).select("issue", F.col("n").cast("long").alias("n"))


@register("rejected_input", "SELECT * FROM (VALUES ('dimension', 'Dimension Error'), ('duplicate', 'Duplicate IDs'), ('known id', 'Duplicate IDs'), ('negative', 'Negative ID'), ('query', 'Dimension Error'), ('rows', 'Row Limit'), ('unknown', 'Unknown ID')) t(input, error)")
def rejected_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of error for each bad input, over the whole table: labels as ids, vectors cut, ids turned negative and so on."""
    rows, index = corpus(spark, sf_dir).select("id", "vector"), _index(spark, sf_dir)
    calls = {
        "dimension": lambda: VectorIndex(spark, 64).add(rows.withColumn("vector", F.slice("vector", 1, 8))),
        "duplicate": lambda: VectorIndex(spark, 64).add(corpus(spark, sf_dir).select(F.col("label").cast("long").alias("id"), "vector")),
        "known id": lambda: index.add(rows),
        "negative": lambda: VectorIndex(spark, 64).add(rows.withColumn("id", -F.col("id"))),
        "query": lambda: index.search([1.0], K),
        "rows": lambda: VectorIndex(spark, 64, max_rows=3).add(rows),
        "unknown": lambda: index.update(-1, [0.0] * 64),
    }
    found = []
    for name, call in calls.items():
        try:
            call()
        except VectorError as e:
            found.append((name, e.kind))
    return spark.createDataFrame(found, "input string, error string")


@register("duplicate_ids", "SELECT CAST(label AS BIGINT) AS id, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_ids(corpus(spark, sf_dir).withColumn("id", F.col("label").cast("long")))


@register("metadata_defaults", "SELECT vec_id AS id, coalesce(quality, 0)::BIGINT AS quality, '' AS country, 0.0::DOUBLE AS score, 0::BIGINT AS n_tags, 0::BIGINT AS seen FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id")
def metadata_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Schema({"quality": "int", "country": "string", "score": "float", "tags": "tags", "seen": "timestamp"})
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    rows = corpus(spark, sf_dir).select("id").join(labels, "id", "left")
    return rows.select("id", *schema.columns(rows)).select("id", "quality", "country", "score", F.size("tags").cast("long").alias("n_tags"), F.unix_timestamp("seen").alias("seen"))


@register("metadata_added", "SELECT vec_id AS id, coalesce(lang, '') AS lang, coalesce(n_chars, 0)::BIGINT AS n_chars, 0.0::DOUBLE AS score FROM embeddings LEFT JOIN documents ON doc_id = vec_id")
def metadata_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata that comes with the vectors, through the index; what is missing takes its type's default."""
    index = VectorIndex(spark, 64)
    index.set_metadata_schema({"lang": "string", "n_chars": "int", "score": "float"})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    index.add(corpus(spark, sf_dir).select("id", "vector").join(docs, "id", "left"))
    return index.rows().select("id", "lang", F.col("n_chars").cast("long").alias("n_chars"), F.col("score").cast("double").alias("score"))


@register("knn_saved_loaded", knn_sql("cosine", where="c.id % 7 <> 0"))
def knn_saved_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed rows stay away when an index is saved and loaded."""
    rows = corpus(spark, sf_dir)
    index = VectorIndex(spark, 64, "cosine").add(rows.select("id", "vector"))
    index.remove(rows.where("id % 7 = 0").select("id"))
    root, name = shared_folder(spark), f"indices/{uuid.uuid4().hex}"
    index.save(name, root)
    return rounded(VectorIndex.load(spark, name, root).search_batch(some_queries(rows), K))


@register("knn_cells_saved_loaded", knn_sql("manhattan"))
def knn_cells_saved_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    root, name = shared_folder(spark), f"indices/{uuid.uuid4().hex}"
    CellIndex(spark, 64, "manhattan", Config(max_elements=10**9)).add(rows.select("id", "vector")).build().save(name, root)
    return rounded(CellIndex.load(spark, name, root).search_batch(some_queries(rows), K, probes=10**6))


@register("knn_named_filter", knn_sql(where="c.id IN (SELECT id FROM (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) WHERE pos < 400 AND pos % 3 = 1)"))
def knn_named_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    index.update_boolean_filter("thirds", [i % 3 == 1 for i in range(400)])
    return rounded(index.search_batch(some_queries(corpus(spark, sf_dir)), K, "thirds"))


@register("positions_after_changes", "SELECT * FROM (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, CASE WHEN vec_id = 40 THEN 2 ELSE 1 END AS version FROM embeddings) WHERE id <> 41")
def positions_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An updated row keeps its position, a removed one leaves a gap, which compact() isn't asked to close here."""
    index = _index(spark, sf_dir)
    index.update(40, [0.0] * 64)
    index.remove([41])
    return index.rows().select("id", "pos", "version")


@register("search_calls", f"WITH {CORPUS_SQL}, one AS (SELECT v AS q FROM corpus WHERE id = 9), d AS (SELECT c.id, label, {DIST_SQL['euclidean']} AS dist FROM corpus c CROSS JOIN one), calls(call) AS (VALUES ('allowed'), ('callback'), ('facade'), ('filtered'), ('search'), ('wrapper')), r AS (SELECT call, id, dist, row_number() OVER (PARTITION BY call ORDER BY dist, id) AS rank FROM d, calls WHERE CASE call WHEN 'allowed' THEN id % 4 = 1 AND id < 400 WHEN 'callback' THEN id % 6 = 5 WHEN 'filtered' THEN id > 100 ELSE true END) SELECT call, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM r WHERE rank <= {K}")
def search_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query through each way to ask: the index, its filters, the wrapper for threads and the face for both kinds."""
    rows, index = corpus(spark, sf_dir), _index(spark, sf_dir)
    q = rows.where("id = 9").first().vector
    wrapper, face = ThreadSafeIndex(spark, 64), Index(spark, "exact", 64)
    wrapper.add(rows.select("id", "vector"))
    face._index.add(rows.select("id", "vector"))
    found = {
        "allowed": index.search_allowed(q, K, range(1, 400, 4)), "callback": index.search_callback(q, K, lambda i: i % 6 == 5), "facade": face.search(q, K),
        "filtered": index.search_filtered(q, K, "id > 100"), "search": index.search(q, K), "wrapper": wrapper.search(q, K),
    }
    out = [(call, rank + 1, int(i), float(d)) for call, (ids, dist) in found.items() for rank, (i, d) in enumerate(zip(ids, dist))]
    return rounded(spark.createDataFrame(out, "call string, rank int, id long, dist double"))


@register("items_added", "SELECT * FROM (VALUES ('cells', 0, 3), ('exact', 0, 3)) t(kind, first, size)")
def items_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors appended one by one take the numbers of their slots."""
    vectors = [r.vector for r in corpus(spark, sf_dir).where("id < 3").orderBy("id").collect()]
    out = []
    for kind, index in (("cells", CellIndex(spark, 64)), ("exact", VectorIndex(spark, 64))):
        ids = [index.add_item(v) for v in vectors]
        out.append((kind, ids[0], len(index)))
    return spark.createDataFrame(out, "kind string, first int, size int")


@register("metrics_snapshot", "SELECT 3::BIGINT AS query_count, count(*) AS index_size, 64 AS dimensions, 'cosine' AS distance_metric, 0.95::DOUBLE AS recall_at_10 FROM embeddings")
def metrics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the collector says after two searches and a batch."""
    rows = corpus(spark, sf_dir)
    index = VectorIndex(spark, 64, "cosine").add(rows.select("id", "vector"))
    index.enable_metrics()
    q = rows.where("id = 9").first().vector
    index.search(q, K)
    index.search(q, K)
    index.search_batch(some_queries(rows), K).count()
    index.update_recall_estimate(10, 0.95)
    s = index.metrics()
    return spark.createDataFrame([(s["query_count"], s["index_size"], s["dimensions"], s["distance_metric"], s["recall_estimates"][10])], "query_count long, index_size long, dimensions int, distance_metric string, recall_at_10 double")


# Metrics that users register


def _custom_query(name: str, function, dist: str, block=None) -> None:
    @register(f"knn_custom_{name}", knn_sql(dist))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        registry.register_metric(name, function, block)
        rows = corpus(spark, sf_dir)
        return rounded(search.nearest_batch(rows, some_queries(rows), K, D.Metric(name)))


_custom_query("l15", lambda a, b: sum(abs(x - y) ** 1.5 for x, y in zip(a, b)) ** (1 / 1.5), "l15")
_custom_query("own_manhattan", lambda a, b: sum(abs(x - y) for x, y in zip(a, b)), "manhattan")
# These two also over blocks, whose terms and their order are those of the SQL.


def _mahalanobis(a: list[float], b: list[float]) -> float:
    d = [0.0, *(x - y for x, y in zip(a, b)), 0.0]
    total = sum(0.75 * x * x - 0.25 * x * before - 0.25 * x * after for before, x, after in zip(d, d[1:], d[2:]))
    return (0.0 if total < 0 else total) ** 0.5


def _mahalanobis_block(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    d, beside = rows - q, np.zeros_like(rows[:, :1])
    quarter = 0.25 * d
    terms = 0.75 * d * d - quarter * np.hstack([beside, d[:, :-1]]) - quarter * np.hstack([d[:, 1:], beside])
    return np.sqrt(np.maximum(0.0, D.added(terms)))


def _weighted(a: list[float], b: list[float]) -> float:
    return sum(i * (x - y) * (x - y) for i, (x, y) in enumerate(zip(a, b), 1)) ** 0.5


def _weighted_block(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = rows - q
    return np.sqrt(D.added(np.arange(1.0, len(q) + 1) * d * d))


_custom_query("mahalanobis", _mahalanobis, "mahalanobis", _mahalanobis_block)
_custom_query("weighted", _weighted, "weighted", _weighted_block)


@register("knn_unregistered", knn_sql())
def knn_unregistered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    return rounded(search.nearest_batch(rows, some_queries(rows), K, D.Metric("nobody_knows_it")))


# Approximate search


def _cells(spark: SparkSession, sf_dir: str, of: str = "euclidean") -> CellIndex:
    return CellIndex(spark, 64, of, Config(max_elements=10**9)).add(corpus(spark, sf_dir).select("id", "vector")).build()


@register("knn_ivf_full_probe", knn_sql())
def knn_ivf_full_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cells(spark, sf_dir).search_batch(some_queries(corpus(spark, sf_dir)), K, probes=10**6))


@register("knn_ivf")
def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cells(spark, sf_dir).search_batch(some_queries(corpus(spark, sf_dir)), K))


@register("recall_full_probe", f"SELECT vec_id AS q_id, 1.0::DOUBLE AS recall FROM embeddings WHERE vec_id % {STEP} = 0")
def recall_full_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    return bench_stats.recall_at_k(search.nearest_batch(rows, some_queries(rows), K), _cells(spark, sf_dir).search_batch(some_queries(rows), K, probes=10**6), K)


@register("recall_ivf")
def recall_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    return bench_stats.recall_at_k(search.nearest_batch(rows, some_queries(rows), K), _cells(spark, sf_dir).search_batch(some_queries(rows), K), K)


@register("recall_floor", "SELECT * FROM (VALUES ('cosine', true), ('euclidean', true), ('manhattan', true)) t(metric, enough)")
def recall_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the cells, as set by default, find 0.9 of the exact neighbours over the query set, for vectors of unlike norms."""
    rows, out = scaled(corpus(spark, sf_dir)).withColumn("vector", F.col("vector").cast("array<float>")), []
    for of in ("cosine", "euclidean", "manhattan"):
        cells = CellIndex(spark, 64, of, Config(max_elements=10**9)).add(rows.select("id", "vector")).build()
        recall = bench_stats.recall_at_k(search.nearest_batch(rows, some_queries(rows), K, of), cells.search_batch(some_queries(rows), K), K).agg(F.avg("recall")).first()[0]
        out.append((of, recall >= 0.9))
    return spark.createDataFrame(out, "metric string, enough boolean")


@register("knn_cells_after_changes", knn_sql(rows="base AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings), corpus AS (SELECT id, v, label FROM base WHERE id <> 20 AND id % 10 <> 3 UNION ALL SELECT 20, v, label FROM base WHERE id = 5)"))
def knn_cells_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal, update and compaction of the cell index, all cells probed."""
    rows, cells = corpus(spark, sf_dir), _cells(spark, sf_dir)
    cells.remove(rows.where("id % 10 = 3").select("id"))
    cells.update(20, rows.where("id = 5").first().vector)
    cells.compact()
    return rounded(cells.search_batch(some_queries(cells.rows()), K, probes=10**6))


# Monitoring and benchmark records; `events` stands for a query log


@register("latency_percentiles", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS largest, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latency_stats(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "event_type")
    return found.select("event_type", "n", F.round("mean", 6).alias("mean"), "least", "largest", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")))


@register("dashboard_means", "SELECT event_type AS dataset, count(*) AS records, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def dashboard_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("dataset"), "value")
    return bench_stats.dashboard(records, ["value"]).select("dataset", "records", F.round("value", 6).alias("mean"))


@register("latency_windows", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency_windows(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "value").withColumn("mean", F.round("mean", 6))


@register("regression_lag", "WITH r AS (SELECT event_type AS dataset, 'value' AS stat, value AS now, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS before, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) SELECT dataset, stat, before, now, round((now - before) / nullif(before, 0), 6) AS change, coalesce((now - before) / nullif(before, 0), 0) > 0.25 AS worse FROM r WHERE n = 1 AND before IS NOT NULL")
def regression_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("dataset"), F.col("event_id").alias("ts"), "value")
    return bench_stats.regressions(log, ["value"]).withColumn("change", F.round("change", 6))


@register("compare_results", "WITH h AS (SELECT event_type AS path, avg(value) FILTER (event_id % 2 = 0) AS old, avg(value) FILTER (event_id % 2 = 1) AS new FROM events GROUP BY 1) SELECT path, round(old, 6) AS old, round(new, 6) AS new, round((new - old) / nullif(abs(old), 0), 6) AS change, coalesce((new - old) / nullif(abs(old), 0) > 0.2, false) AS worse FROM h")
def compare_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = lambda r: log.where(F.col("event_id") % 2 == r).groupBy(F.col("event_type").alias("path")).agg(F.avg("value").alias("value"))
    found = bench_stats.compare(half(0), half(1))
    return found.select("path", *(F.round(c, 6).alias(c) for c in ("old", "new", "change")), "worse")
