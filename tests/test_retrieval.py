import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import filters
from larkspan.functions.text import words
from larkspan.operators import evaluate, hnsw, knn
from larkspan.operators import hybrid as H
from larkspan.operators import inverted as I
from larkspan.plans.planner import AdaptivePlanner, Plan, Planner, Strategy, needs_fallback
from larkspan.types import InvalidParameter

CATALOGUE = [(1, "shoes,running,blue,nike"), (2, "shoes,running,red,adidas"), (3, "shoes,casual,white,nike"), (4, "hat,baseball,blue,nike"), (5, "shoes,hiking,brown,merrell")]


@pytest.fixture(scope="module")
def catalogue(spark):
    docs = spark.createDataFrame(CATALOGUE, "doc_id long, tags string").select("doc_id", F.split("tags", ",").alias("tags"))
    return I.tag_postings(docs, F.col("tags")).cache()


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_boolean(catalogue, spark):
    assert ids(I.all_of(catalogue, ["blue", "nike"])) == [1, 4]
    assert ids(I.all_of(catalogue, ["shoes", "running", "blue"])) == [1]
    assert ids(I.all_of(catalogue, ["shoes", "nothing"])) == ids(I.all_of(catalogue, [])) == []
    assert ids(I.any_of(catalogue, ["nike", "Adidas"])) == [1, 2, 3, 4]
    assert ids(I.without(catalogue, "shoes", "red")) == [1, 3, 5]
    universe = spark.range(1, 6).toDF("doc_id")
    assert ids(I.matching(catalogue, universe, I.And((I.Term("shoes"), I.Not(I.Term("nike")))))) == [2, 5]
    assert ids(I.matching(catalogue, universe, I.Not(I.Term("shoes")))) == [4]


def test_removal(catalogue, spark):
    left = I.removed(catalogue, spark.createDataFrame([(1,)], "doc_id long"))
    assert ids(I.term(left, "running")) == [2]
    fresh = spark.createDataFrame([("hat", 2)], "term string, doc_id long")
    assert ids(I.term(I.upserted(catalogue, fresh), "hat")) == [2, 4] and ids(I.term(I.upserted(catalogue, fresh), "red")) == []


def test_set_algebra(spark):
    t = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    assert ids(I.intersect(t(1, 3, 5, 7, 9), t(2, 3, 5, 8, 10))) == [3, 5]
    assert ids(I.union(t(1, 3, 5), t(2, 3, 6))) == [1, 2, 3, 5, 6]
    assert ids(I.difference(t(1, 2, 3, 4, 5), t(2, 4))) == [1, 3, 5]
    assert ids(I.intersect_all([t(1, 2, 3, 4, 5), t(2, 3, 5, 8), t(3, 5, 7, 9)])) == [3, 5]
    assert ids(I.union_all([t(1, 2), t(2, 3), t(3, 4)])) == [1, 2, 3, 4]


def test_words(spark):
    df = spark.createDataFrame([("The quick brown fox, jumps over the 'lazy' dog!",)], "text string")
    assert df.select(words(F.col("text"))).first()[0] == ["quick", "brown", "fox", "jumps", "over", "lazy", "dog"]


PRODUCTS = [
    (0, '{"category":"shoes","brand":"Nike","price":89,"tags":["running","road"],"title":"fast running shoes"}'),
    (1, '{"category":"hats","brand":"Nike","price":24,"tags":["sun"],"title":"running hat shoes"}'),
    (2, '{"category":"shoes","brand":"Adidas","price":120,"tags":["trail","running"],"title":"trail shoes"}'),
]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("category:shoes", [0, 2]),
        ("category:shoes AND brand:nike", [0]),
        ("price:<89", [1]),
        ("price:>=89", [0, 2]),
        ("tags:running", [0, 2]),
        ('title:"running shoes"', [0]),
        ("NOT category:shoes", [1]),
        ("category:hats brand:adidas", [1, 2]),
        ("(brand:adidas OR category:hats) AND NOT price:>100", [1]),
        ("missing:x OR price:>100", [2]),
        ("brand:nike OR brand:adidas AND price:<30", [0, 1]),
    ],
)
def test_filter_language(spark, query, want):
    df = spark.createDataFrame(PRODUCTS, "point_id long, metadata string")
    assert ids(df.filter(filters.where(query, filters.json_field(F.col("metadata"))))) == want


@pytest.mark.parametrize("query", ["", "(a:b", "a:b)", "AND a:b", "a", "NOT"])
def test_filter_errors(query):
    with pytest.raises(InvalidParameter):
        filters.parse(query)


def test_planner():
    p = Planner()
    assert p.plan(100_000, 50, 10) == Plan(Strategy.BRUTE_FORCE, 0.0005)
    assert p.plan(100_000, 5000, 10) == Plan(Strategy.FILTER_FIRST, 0.05)
    assert p.plan(100_000, 80_000, 10) == Plan(Strategy.VECTOR_FIRST, 0.8, 19)
    assert p.plan(0, 0, 10).strategy is Strategy.BRUTE_FORCE
    assert p.plan(10, 5, 1).strategy is Strategy.FILTER_FIRST
    assert [p.expansion(10, s) for s in (0.2, 0.5, 0.9)] == [75, 30, 17]
    assert Planner(cap=100).expansion(10, 0.001) == 100
    assert not needs_fallback(2, 3) and needs_fallback(1, 10)
    assert AdaptivePlanner().plan(100, 60, 5).strategy is Strategy.VECTOR_FIRST


def test_hybrid(spark):
    v = [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [0.5, 0.5, 0.0]), (4, [0.0, 0.5, 0.5])]
    pts = spark.createDataFrame([(i, x, f'{{"n":{i}}}') for i, x in v], "point_id long, vector array<float>, metadata string")
    got = H.brute_force(pts, F.col("point_id").isin(0, 1, 2), [1, 0, 0], 2).collect()
    assert got[0].point_id == 0 and got[0].score > 0.99
    assert set(ids(H.vector_first(pts, F.col("point_id").isin(0, 3), [1, 0, 0], 2, 5))) == {0, 3}
    e = H.HybridEngine(pts)
    assert e.selectivity("n:<1") == 0.2
    q = H.HybridQuery((1.0, 0, 0), 3).with_filter("n:<4").with_ef(50)
    assert [r.point_id for r in e.search(q).collect()] == [0, 3, 1] and q.ef == 50
    assert H.HybridEngine(pts.limit(0)).search(q).count() == 0


def test_hnsw_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = hnsw.build(e, rows_per_shard=200).cache()
    found = hnsw.search(index, q, 10).withColumnRenamed("node_id", "vec_id").cache()
    truth = knn.batch(e, q, 10, "euclidean")
    assert evaluate.recall(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.9
    assert found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).filter("n <> 10").isEmpty()
    some = hnsw.search(index, q, 5, allowed=e.filter("label = 3").select("vec_id"))
    assert some.join(e.filter("label = 3"), F.col("node_id") == F.col("vec_id"), "left_anti").isEmpty()
    assert hnsw.search(index, q, 5, with_stats=True).filter("visited > 0 and layers >= 1").count() == q.count()


@pytest.mark.parametrize("share", [1.0, 0.5, 0.1, 0.01])
def test_hnsw_masked(share):
    """Recall on clusters of points, walking through points that the mask leaves out."""
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(size=(60, 12)) for c in rng.normal(size=(30, 12)) * 8])
    built = hnsw.Graph(np.arange(len(x)), x).build()
    g = hnsw.Graph.load(*built.packed(), 16)
    assert g.links == built.links and g.levels == built.levels and g.entry == built.entry
    mask = rng.random(len(x)) < share
    mask[:12] = True
    hits = total = 0
    for q in rng.normal(size=(40, 12)) * 8:
        d = np.where(mask, ((x - q) ** 2).sum(1), np.inf)
        found = [n for _, n in g.search(q, 10, 100, None if share == 1 else mask)]
        assert len(found) == 10 and (share == 1 or all(mask[n] for n in found))
        hits, total = hits + len(set(found) & set(np.argsort(d, kind="stable")[:10].tolist())), total + 10
    assert hits >= 0.9 * total


def test_hnsw_stored(spark, sf, tmp_path):
    """An index written, read, and grown finds what a new one finds; no search shuffles it."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    half = hnsw.save(hnsw.build(e.filter("vec_id % 2 = 0"), rows_per_shard=60), f"file://{tmp_path}/half")
    grown = hnsw.save(hnsw.insert(half, e), f"file://{tmp_path}/grown")
    assert grown.agg(F.sum("nodes")).first()[0] == e.count()
    found = hnsw.search(grown, q, 10).withColumnRenamed("node_id", "vec_id")
    assert evaluate.recall(found, knn.batch(e, q, 10, "euclidean"), 10).agg(F.avg("recall")).first()[0] >= 0.9
    plan = hnsw._block(grown, [0], np.zeros((1, 64)), 1, 10, 16, False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_stored_index(spark, tmp_path):
    """Segments, removals and a merge give what an index of the last state gives; a search reads its terms' files only."""
    docs = spark.createDataFrame([(i, f"word{i % 7} and common word{i % 3} text") for i in range(50)], "doc_id long, text string")
    path = f"file://{tmp_path}/index"
    index = I.Index(spark, path).add(docs.filter("doc_id < 30")).add(docs.filter("doc_id >= 30"))
    index = index.add(spark.createDataFrame([(3, "other words")], "doc_id long, text string")).remove(spark.createDataFrame([(4,)], "doc_id long"))
    want = I.positions(docs.filter("doc_id NOT IN (3, 4)").unionByName(spark.createDataFrame([(3, "other words")], "doc_id long, text string")))
    state = lambda x: {(r.term, r.doc_id, r.tf, tuple(r.positions)) for r in x.collect()}
    assert state(I.Index(spark, path).postings()) == state(want)
    merged = I.Index(spark, path).optimize()
    assert state(merged.postings()) == state(want) and len(merged.segments) == 1 and not merged.removals
    assert merged.lengths().count() == 49
    plan = merged.postings().filter("term = 'common'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,common)" in plan
    assert I.Index(spark, f"file://{tmp_path}/none").postings().count() == 0


def test_masks(spark):
    pts = spark.createDataFrame([(0, [1.0], '{"a":1}'), (2, [1.0], '{"a":2}')], "point_id long, vector array<double>, metadata string")
    e = H.HybridEngine(pts)
    one, two = e.bitmask("a:1"), e.bitmask("a:2", 4)
    values = lambda m: [r.matches for r in m.orderBy("point_id").collect()]
    assert values(one) == [True, False, False] and values(two) == [False, False, True, False]
    assert values(H.mask_or(one, two)) == [True, False, True, False] and values(H.mask_and(one, H.mask_not(two))) == [True, False, False, False]
    assert ids(H.mask_ids(two)) == [2] and H.mask_stats(two).first().selectivity == 0.25


def test_field_words(spark):
    """Whatever is no letter or digit parts words, and phrases stay within an element of an array."""
    df = spark.createDataFrame([('{"t":["red-blue car","green, fast"],"s":"a_b/c"}',)], "metadata string")
    holds = lambda q: df.filter(filters.where(q, filters.json_field(F.col("metadata")))).count() == 1
    assert holds("t:blue") and holds('t:"blue car"') and holds("s:b") and holds("t:red-blue")
    assert not holds('t:"car green"') and holds('t:"green fast"') and not holds("t:redblue")


def test_hnsw_blocks(spark, sf, monkeypatch):
    """Any number of queries: blocks of them give what one call gives, and more than 10 000 are answered."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").limit(60)
    index = hnsw.build(e).cache()
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).cache()
    many = q.crossJoin(spark.range(170)).select((F.col("query_id") * 1000 + F.col("id")).alias("query_id"), "query")
    assert many.count() > 10_000 and hnsw.search(index, many, 1, ef=5).count() == many.count()
    whole = set(hnsw.search(index, q, 5).collect())
    monkeypatch.setattr(hnsw, "BLOCK_QUERIES", 17)
    assert set(hnsw.search(index, q, 5).collect()) == whole and len(whole) == 5 * q.count()


def test_hnsw_small():
    rng = np.random.default_rng(1)
    g = hnsw.Graph(np.arange(1000), rng.random((1000, 2)), 16, 40).build()
    sizes = [sum(lv >= lay for lv in g.levels) for lay in range(max(g.levels) + 1)]
    assert sizes[0] == 1000 and sizes == sorted(sizes, reverse=True)
    x = np.array([[0.1 * i, 0.0] for i in range(5)] + [[10.0, 10.0]])
    g = hnsw.Graph(np.arange(6), x, 2, 10).build()
    assert any(5 in layer for node in g.links[:5] for layer in node) or g.links[5][0]
    assert g.nearest([(2.0, 1), (1.0, 4)], 1) == [4]
    assert len(g.angular(x[0], [(0.1, 1), (0.2, 2), (14.0, 5)], 2)) == 2
    assert hnsw.Graph(np.arange(0), np.zeros((0, 2))).search(np.zeros(2), 3, 10) == []
    assert hnsw.strategy_for(10) == ("brute", None) and hnsw.strategy_for(10**6) == ("hnsw", 100)
