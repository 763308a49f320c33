import functools
import math
import os
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.errors import VectorError, VectorIOError
from nearfield.functions import distances as D
from nearfield.functions import registry
from nearfield.operators import search
from nearfield.operators.ann import CellIndex, Config, Index
from nearfield.operators.filters import Filter
from nearfield.operators.index import ThreadSafeIndex, VectorIndex
from nearfield.plans import catalog
from nearfield.plans.predicates import parse
from nearfield.sources.paths import checked
from nearfield.streaming.ingest import add_stream, latency_windows, search_stream

SIX = [(1, 2, 3), (4, 5, 6), (7, 8, 9), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
IDS = [10, 11, 12, 13, 14, 15]


@pytest.fixture(scope="module")
def six(spark):
    return VectorIndex(spark, 3).add(SIX, IDS)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def kind(error):
    return error.value.kind


def test_metric_goldens(spark):
    cases = [("euclidean", None, (1, 2, 3), (4, 5, 6), 5.196152), ("manhattan", None, (1, 2, 3), (4, 5, 6), 9), ("chebyshev", None, (1, 2, 3), (4, 5, 7), 4), ("cosine", None, (1, 0), (0, 1), 1), ("sqeuclidean", None, (1, 2, 3), (1, 0, 0), 13), ("cosine", None, (0, 0), (1, 1), 1), ("angular", None, (0, 0), (1, 1), math.pi / 2), ("angular", None, (1, 0), (0, 1), math.pi / 2), ("hamming", None, (0, 1), (0, 2), 1), ("jaccard", None, (0, 1), (1, 1), 0.5), ("jaccard", None, (0, 0), (0, 0), 0), ("canberra", None, (0, 1), (0, 3), 0.5), ("minkowski", 3, (1, 2, 2), (0, 0, 0), 17 ** (1 / 3)), ("minkowski", math.inf, (1, 5), (0, 0), 5), ("minkowski", 1, (1, 5), (0, 0), 6), ("minkowski", 2, (3, 4), (0, 0), 5)]
    for name, p, a, b, expected in cases:
        df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "v array<float>, q array<float>")
        m = D.Metric(name, p)
        assert df.select(D.distance(m, F.col("v"), F.col("q"))).first()[0] == pytest.approx(expected, abs=1e-5)
        assert D.block_distance(m, np.array([a], float), np.array(b, float))[0] == pytest.approx(expected, abs=1e-5)


def test_metric_names():
    assert D.Metric("L2").name == D.Metric("Euclidean").name == "euclidean"
    assert D.Metric("mine").is_custom and str(D.Metric("minkowski", 3)) == "minkowski_p3"
    with pytest.raises(ValueError):
        D.Metric("minkowski", 0)


numbers = st.floats(-100, 100, width=32)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(numbers, min_size=3, max_size=3), st.lists(numbers, min_size=3, max_size=3), st.sampled_from(D.BUILT_IN))
def test_metric_laws(a, b, name):
    m = D.Metric(name, 3 if name == "minkowski" else None)
    d = lambda x, y: D.block_distance(m, np.array([x], float), np.array(y, float))[0]
    assert d(a, b) == pytest.approx(d(b, a), abs=1e-6) and d(a, b) >= 0
    if name not in ("cosine", "angular"):
        assert d(a, a) == 0


def test_search(six):
    ids, dist = six.search([1, 2, 3], 3)
    assert ids.tolist() == [10, 14, 15][:1] + ids.tolist()[1:] and dist[0] == 0 and len(ids) == 3 and sorted(dist) == dist.tolist()
    batch = six.search_batch([SIX[0], SIX[1]], 2).collect()
    assert len(batch) == 4
    for q in (0, 1):
        ids, dist = six.search(SIX[q], 2)
        assert [(r.id, r.dist) for r in sorted(batch, key=lambda r: r.rank) if r.q_id == q] == [(i, pytest.approx(d)) for i, d in zip(ids, dist)]
    assert len(six.search([0, 0, 0], 50)[0]) == 6 and len(six.search([0, 0, 0], 0)[0]) == 0 and six.search_batch([SIX[0]], 0).count() == 0
    assert repr(six) == "VectorIndex(dim=3, metric=euclidean, entries=6)"


def test_ties_and_nan(spark):
    index = VectorIndex(spark, 2).add([(1, 1), (float("nan"), 0), (1, 1), (2, 2)], [5, 6, 3, 1])
    assert index.search([1, 1], 4)[0].tolist() == [3, 5, 1, 6]
    assert [r.id for r in index.search_batch([(1, 1)], 4).orderBy("rank").collect()] == [3, 5, 1, 6]


def test_filters(six):
    find = lambda f: set(six.search([0, 0, 0], 6, f)[0].tolist())
    assert find(Filter.id_range(11, 14)) == {11, 12, 13, 14}
    assert find(Filter.id_set([10, 15])) == {10, 15} and find(Filter.id_set([])) == set()
    assert find(Filter.compound([Filter.id_range(13, 20), Filter.id_set([10, 11])])) == {10, 11, 13, 14, 15}
    assert find(Filter.boolean([True, False] * 3)) == {10, 12, 14} and find(Filter.boolean([False, True])) == {11}
    assert find(Filter.all_of([])) == set(IDS) and find(Filter.any_of([])) == set()
    assert find(~Filter.id_range(11, 14)) == {10, 15} and find(Filter.callback(lambda i: i % 2 == 0)) == {10, 12, 14}
    assert find(Filter.id_set(range(2000)) & ~Filter.id_set(list(range(11, 3000)))) == {10}
    assert find(Filter.boolean([True] * 3 + [False] * 2000)) == {10, 11, 12}
    six.update_boolean_filter("even", [True, False] * 3)
    assert find("even") == {10, 12, 14} and six.get_boolean_filter("none") is None
    assert set(six.search_allowed([0, 0, 0], 6, [11])[0]) == {11} and set(six.search_callback([0, 0, 0], 6, lambda i: i > 14)[0]) == {15}


def test_metadata(spark, folder):
    index = VectorIndex(spark, 2)
    index.set_metadata_schema({"country": "string", "score": "float", "tags": "tags", "seen": "timestamp", "n": "int"})
    index.add([(0, 0), (1, 1)], [1, 2], {"country": ["IN", "DE"], "score": [0.9, 1], "tags": [["a", "b"], []], "seen": [60, None]})
    index.add([(2, 2)], [3], {"country": ["IN"], "score": [0.5]})
    assert index.search_filtered([0, 0], 3, 'country=="IN" AND score>0.8')[0].tolist() == [1]
    assert index.search_filtered([0, 0], 3, "array_contains(tags, 'b') or n = 0 and score < 0.6")[0].tolist() == [1, 3]
    index.save("data/meta", folder)
    again = VectorIndex.load(spark, "data/meta", folder)
    key = lambda r: r["id"]
    assert sorted(again.rows().select(*index.rows().columns).collect(), key=key) == sorted(index.rows().collect(), key=key) and again.schema == index.schema
    for data, expected in (({"country": [1]}, "Metadata Type Error"), ({"other": ["x"]}, "Unknown Metadata Field")):
        with pytest.raises(VectorError) as e:
            index.add([(3, 3)], [4], data)
        assert kind(e) == expected


@pytest.mark.parametrize("bad", ["1; drop table x", "(select 1) = 1", "reflect('a')", "country == 'IN' --", "country = `x`", "other = 1", "", "array_contains"])
def test_bad_predicates(bad):
    with pytest.raises(VectorError):
        parse(bad, ["country"])


@pytest.mark.parametrize("value", ["\\' or version() is not null --", "it's", 'a"b', "\\", "\\\\", "'", "\\'", "x' or 1 = 1 --", "", "\n", "%", "é\U0001f600"])
def test_strings_mean_their_characters(spark, value):
    """Backslashes and quotes in any place: the predicate finds the row with just that value, in either kind of quotes."""
    rows = spark.createDataFrame([(1, value), (2, "other"), (3, "\\' or version() is not null --x")], "id long, lang string")
    for quote in "'\"":
        token = quote + value.replace("\\", "\\\\").replace(quote, "\\" + quote) + quote
        assert [r.id for r in rows.where(parse(f"lang == {token}", rows.columns)).collect()] == [1]
    assert rows.where(parse("lang LIKE 'oth%'", rows.columns)).count() == 1
    # What once passed for a condition of its own is a value that no row has.
    assert rows.where(parse('lang == "\\\\\' or version() is not null -- "', rows.columns)).count() == 0


def test_changes(spark):
    index = VectorIndex(spark, 3, "cosine").add(SIX, IDS)
    assert index.remove([11, 14, 99]) == 2 and (len(index), index.capacity, index.deleted_count, index.version) == (4, 6, 2, 2)
    assert not {11, 14} & set(index.search([4, 5, 6], 3)[0].tolist()) and index.should_compact()
    index.set_max_deleted_ratio(0.5)
    assert not index.should_compact()
    index.update(12, (1, 0, 0))
    assert index.search([1, 0, 0], 2)[0].tolist() == [12, 13] and len(index) == 4
    with pytest.raises(VectorError) as e:
        index.update(11, (1, 0, 0))
    assert kind(e) == "Unknown ID"
    index.add([(9, 9, 9)], [11])
    index.compact()
    assert (len(index), index.capacity, index.deleted_count) == (5, 5, 0) and [r.pos for r in index.rows().orderBy("pos").collect()] == list(range(5))
    with pytest.raises(VectorError):
        index.set_max_deleted_ratio(2)
    assert index.validate() == []
    with pytest.raises(VectorError) as e:
        index.search([1, 0, 0], 1, version=1)
    assert kind(e) == "ConcurrentModification"


def test_errors(spark, six):
    for call, expected in [
        (lambda: VectorIndex(spark, 0), "Dimension Error"), (lambda: VectorIndex(spark, 10_000), "Dimension Error"), (lambda: VectorIndex.minkowski(spark, 5000, 2), "Dimension Error"),
        (lambda: VectorIndex(spark, 2).search([0, 0], 1), "EmptyIndex"), (lambda: six.search([0, 0], 1), "Dimension Error"), (lambda: six.search_batch([[0, 0]], 1), "Dimension Error"),
        (lambda: six.add([(1, 2, 3)], [10]), "Duplicate IDs"), (lambda: six.add([(1, 2, 3)] * 2, [70, 70]), "Duplicate IDs"), (lambda: six.add([(1, 2, 3)], [-1]), "Negative ID"),
        (lambda: six.add([(1, 2)], [70]), "Dimension Error"), (lambda: six.add([(1, 2, 3)], [70, 71]), "Dimension Error"), (lambda: VectorIndex(spark, 1, max_rows=2).add([[1], [2], [3]], [1, 2, 3]), "Row Limit"),
    ]:
        with pytest.raises(VectorError) as e:
            call()
        assert kind(e) == expected
    assert len(six) == 6 and str(VectorError("A", "b\n[c]")) == "[A] b c"


def test_progress(spark):
    seen, index = [], VectorIndex(spark, 1)
    index.add_with_progress([[float(i)] for i in range(5)], range(5), lambda *x: seen.append(x), 2)
    assert seen == [(2, 5), (4, 5), (5, 5)] and len(index) == 5 and index.add_item([9.0]) == 5 and index.build() is index


def test_storage(spark, six, folder):
    six.save("indices/six", folder)
    again = VectorIndex.load(spark, "indices/six", folder)
    assert again.search([1, 2, 3], 6)[0].tolist() == six.search([1, 2, 3], 6)[0].tolist() and again.version == six.version and again.info() == six.info()
    again.remove([10])
    again.save("indices/six", folder)
    assert len(VectorIndex.load(spark, "indices/six", folder)) == 5
    with pytest.raises(VectorIOError, match="Failed to open file"):
        VectorIndex.load(spark, "data/none", folder)


@pytest.mark.parametrize("bad", ["../x", "a/../../x", "%2e%2e/x", "%252e%252e%252fx", "%25252525252e", "/etc/x", "C:/x", "file:///x", "a\\..\\b", "x\0y", "x\ny", "", "other/x", "~/x"])
def test_bad_paths(bad):
    with pytest.raises(VectorError):
        checked(bad)


def test_good_paths():
    assert [checked(p) for p in ("x", "./x", "data/x", "models/a/b", "tmp/./x")] == ["x", "x", "data/x", "models/a/b", "tmp/x"]


def test_registry(spark):
    registry.register_metric("half", lambda a, b: sum(abs(x - y) for x, y in zip(a, b)) / 2)
    registry.register_metric("broken", lambda a, b: 1 / 0)
    assert {"half", "euclidean"} <= set(registry.list_metrics())
    index = VectorIndex(spark, 2, "half").add([(0, 0), (2, 2)], [0, 1])
    assert index.search([0, 0], 2)[1].tolist() == [0, 2] and [r.dist for r in index.search_batch([(0, 0)], 2).orderBy("rank").collect()] == [0, 2]
    assert VectorIndex(spark, 2, "broken").add([(0, 0)], [0]).search([0, 0], 1)[1][0] == registry.FAILED
    assert VectorIndex(spark, 2, "never heard of").add([(3, 4)], [0]).search([0, 0], 1)[1][0] == 5
    with pytest.raises(KeyError):
        registry.get_metric("never heard of")


@pytest.mark.parametrize("name", ["mahalanobis", "weighted"])
def test_metrics_over_blocks(spark, name):
    """A batch search asks the form over blocks alone, which says what the function says; rows for which it fails go to the function."""
    catalog.QUERIES[f"knn_custom_{name}"](spark, "/root/testdata/sf0.001")
    metric = registry.resolve(name)[1]
    rng = np.random.default_rng(5)
    rows, q = rng.normal(size=(1200, 64)), rng.normal(size=64)
    rows[3, 7] = np.nan
    plain = np.array([metric(r, q.tolist()) for r in rows.tolist()])
    assert np.isnan(plain[3]) and metric.over(rows, q) == pytest.approx(plain, rel=1e-12, nan_ok=True)
    for block in (lambda rows, q: 1 / 0, lambda rows, q: rows):
        assert registry.guarded(metric.function, block).over(rows, q).tolist()[:3] == plain.tolist()[:3]
    best = search.Best(np.arange(2), 5)
    best.look(D.Metric(name), registry.guarded(lambda a, b: pytest.fail("called"), metric.block), np.arange(1200), rows, rng.normal(size=(2, 64)))
    assert (np.diff(best.dist) >= 0).all() and np.isfinite(best.dist).all()
    registry.register_metric("once", lambda a, b: 1.0, lambda rows, q: np.zeros(len(rows)))
    registry.register_metric("once", lambda a, b: 1.0)
    assert registry.resolve("once")[1].block is None


def test_quantised(spark):
    values = [1.0, float("nan"), float("inf"), float("-inf"), 2.0]
    assert spark.createDataFrame([(values,)], "v array<float>").select(D.to_int8(F.col("v"))).first()[0] == [127, 0, 0, 0, 127]
    index = Index(spark, "GPU", 2, precision="int8")
    index.add_item([0.5, 0.25])
    assert index.search([0.5, 0.25], 1)[1][0] == 0


@pytest.mark.parametrize("name", ["sqeuclidean", "euclidean", "manhattan", "canberra", "cosine", "angular"])
def test_sums_run_from_left_to_right(name):
    """Quantised vectors have many equal distances, which the order of adding tells apart: it is that of Catalyst and SQL."""
    rng = np.random.default_rng(7)
    rows, q = rng.integers(-40, 41, (300, 64)) / 127, rng.integers(-40, 41, 64) / 127
    total = lambda values: functools.reduce(lambda s, x: s + x, values, 0.0)
    dot = lambda a, b: total(x * y for x, y in zip(a, b))
    cos = lambda a, b: dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))
    plain = {
        "sqeuclidean": lambda a, b: total((x - y) * (x - y) for x, y in zip(a, b)),
        "euclidean": lambda a, b: math.sqrt(total((x - y) * (x - y) for x, y in zip(a, b))),
        "manhattan": lambda a, b: total(abs(x - y) for x, y in zip(a, b)),
        "canberra": lambda a, b: total(abs(x - y) / (abs(x) + abs(y)) if x or y else 0.0 for x, y in zip(a, b)),
        "cosine": lambda a, b: 1 - cos(a, b),
        "angular": lambda a, b: float(np.arccos(cos(a, b))),
    }[name]
    expected = [plain(r, q.tolist()) for r in rows.tolist()]
    for some in (300, 2, 1):
        assert D.block_distance(D.Metric(name), rows[:some], q).tolist() == expected[:some]
    assert D.block_distance(D.Metric(name), rows, np.repeat(q[None], 300, axis=0)).tolist() == expected


def test_cells(spark, folder):
    rng = np.random.default_rng(0)
    data = rng.random((1000, 16), np.float32)
    exact = VectorIndex(spark, 16).add(data, range(5000, 6000))
    cells = CellIndex(spark, 16, config=Config(ef_search=100)).add(data, range(5000, 6000)).build()
    truth, found = exact.search_batch(data[:20], 10), cells.search_batch(data[:20], 10)
    pairs = lambda df: {(r.q_id, r.id) for r in df.collect()}
    assert len(pairs(truth) & pairs(found)) >= 0.85 * 200
    assert pairs(cells.search_batch(data[:20], 10, probes=1000)) == pairs(truth)
    ids, dist = cells.search(data[3], 1)
    assert ids[0] == 5003 and dist[0] == 0 and cells.get_user_id(0) == 5000 and cells.get_user_id(5000) == -1 and cells.validate() == []
    cells.save("models/cells", folder)
    again = CellIndex.load(spark, "models/cells", folder)
    assert again.search(data[3], 5)[0].tolist() == cells.search(data[3], 5)[0].tolist() and again.info() == cells.info()
    for call in (lambda: cells.search(data[0], 0), lambda: cells.add(data[:1], [5000]), lambda: cells.add(data[:1], [-1]), lambda: cells.add(data[:1, :3], [1]), lambda: CellIndex(spark, 16, config=Config(max_elements=1)).add(data[:2], [1, 2]), lambda: Config(m=0)):
        with pytest.raises(VectorError):
            call()


def test_facade(spark):
    for name in ("Brute", "hnsw"):
        index = Index(spark, name, 4)
        index.add_item([1, 2, 3, 4])
        index.add_item([5, 6, 7, 8])
        index.build()
        ids, dist = index.search([1.1, 2.1, 3.1, 4.1], 1)
        assert ids.tolist() == [0] and dist[0] == pytest.approx(0.2, abs=1e-5) and len(index) == 2
    with pytest.raises(ValueError):
        Index(spark, "nothing", 4)


def test_monitoring(spark):
    index = VectorIndex(spark, 2).add([(0, 0), (1, 1)], [0, 1])
    collector = index.enable_metrics(0)
    threads = [threading.Thread(target=lambda: [index.search([0, 0], 1) for _ in range(3)]) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    index.update_recall_estimate(10, 0.9)
    found = index.metrics()
    assert found["query_count"] == 9 and found["avg_query_latency_us"] > 0 and found["index_size"] == 2 and found["recall_estimates"] == {10: 0.9}
    base = f"http://127.0.0.1:{collector.server.server_port}"
    text = urllib.request.urlopen(f"{base}/metrics").read().decode()
    assert "nearfield_query_count 9" in text and text.count("# TYPE") == 6 and urllib.request.urlopen(f"{base}/health").status == 200
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{base}/other")
    collector.stop()


def test_thread_safe(spark):
    index = ThreadSafeIndex(spark, 2)
    threads = [threading.Thread(target=lambda k=k: index.add([(k, k)], [k])) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert index.version == 4 and set(index.search([0, 0], 4)[0]) == {0, 1, 2, 3}
    with pytest.raises(AttributeError):
        index.info  # noqa: B018


def test_streams(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, vector array<float>").write.parquet(str(tmp_path / "in"))
    index = VectorIndex(spark, 2)
    stream = spark.readStream.schema("id long, vector array<float>").parquet(str(tmp_path / "in"))
    add_stream(stream, index, str(tmp_path / "c1")).awaitTermination()
    assert len(index) == 20
    queries = stream.selectExpr("id as q_id", "vector as q").where("q_id < 3")
    search_stream(queries, index, 2, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("rank = 1 and q_id = id").count() == 3
    log = spark.createDataFrame([("2024-01-01 00:01:00", 1.0), ("2024-01-01 00:02:00", 3.0)], "ts string, x double").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.n, r.mean) for r in latency_windows(log, "ts", "x").collect()] == [(2, 2.0)]


def test_plans(spark):
    """Columns and filters reach the scan; one query is a top-k without a full sort."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id as id", "embedding as vector", "label")
    plan = search.nearest(Filter.id_range(5, 50).apply(rows), [0.0] * 64, 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(vec_id), GreaterThanOrEqual(vec_id,5), LessThanOrEqual(vec_id,50)]" in plan
    assert "label" not in plan.split("ReadSchema:")[1]
    assert os.path.exists("/root/testdata")


@pytest.mark.parametrize("n", [500, 2000, 20_000])
def test_cells_recall(spark, n):
    """Recall at 10 of the rows whose id is divisible by 20, with default settings but for the row limit."""
    if n == 20_000:
        data = np.random.default_rng(1).standard_normal((n, 64)).astype(np.float32) / 8
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vector array<float>")
    else:
        rows = spark.read.parquet(f"/root/testdata/sf{0.01 if n == 500 else 0.1}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    assert rows.count() == n
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("q_id"), F.col("vector").alias("q"))
    cells = CellIndex(spark, 64, config=Config(max_elements=10**6)).add(rows).build()
    pairs = lambda df: {(r.q_id, r.id) for r in df.collect()}
    truth = pairs(search.nearest_batch(rows, queries, 10))
    recall = len(truth & pairs(cells.search_batch(queries, 10))) / len(truth)
    print(n, "rows, probes", cells.config.probes(n), "->", cells.probes(), "of", cells.config.cells(n), "recall", recall)
    assert len(truth) == n // 2 and recall >= 0.9


@pytest.mark.parametrize("name", ["knn_half", "knn_ivf", "recall_ivf"])
def test_stated_queries(spark, name):
    """Queries without SQL go over every row whose id is divisible by 20, and recall over them is 0.9."""
    sf = "/root/testdata/sf0.1"
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert {r.q_id for r in rows} == set(range(0, 2000, 20))
    if name == "recall_ivf":
        assert len(rows) == 100 and sum(r.recall for r in rows) / 100 >= 0.9


def test_stated_queries_in_blocks(spark, monkeypatch):
    """The whole query set in several blocks, and k above the whole count, against numpy."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 64 * 10)
    rows = catalog.corpus(spark, "/root/testdata/sf0.01")
    table = sorted((r.id, r.vector) for r in rows.collect())
    matrix = np.array([v for _, v in table])
    for k in (10, len(table) + 5):
        found = search.nearest_batch(rows, catalog.stated_queries(rows), k).collect()
        assert len(found) == 25 * min(k, len(table))
        got = {(r.q_id, r.rank): r.id for r in found}
        for q in range(0, 500, 20):
            dist = np.sqrt(((matrix - matrix[q]) ** 2).sum(axis=1))
            assert [got[q, i + 1] for i in range(10)] == np.lexsort((range(500), dist))[:10].tolist()
