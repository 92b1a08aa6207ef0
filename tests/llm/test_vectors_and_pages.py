"""Vector searches and archives against brute force."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmura.llm import ann_forest, fagin, warc


def vectors(df):
    rows = sorted((r["vec_id"], list(map(float, r["embedding"]))) for r in df.collect())
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def test_nearest_query(spark, data):
    from murmura.llm.queries import op4_nearest

    ids, x = vectors(spark.read.parquet(f"{data}/embeddings.parquet"))
    got = op4_nearest(spark, data).collect()
    assert {r["query_id"] for r in got} == {int(i) for i in ids if i % 100 == 0}
    hits = 0
    for r in got:
        q, v = x[np.searchsorted(ids, r["query_id"])], x[np.searchsorted(ids, r["vec_id"])]
        assert r["score"] == np.sqrt(((v - q) ** 2).sum()) and r["vec_id"] != r["query_id"]
    for q in {r["query_id"] for r in got}:
        far = np.sqrt(((x - x[np.searchsorted(ids, q)]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        true = set(ids[np.lexsort((ids, far))[:10]].tolist())
        hits += len(true & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * len(got)


def table_of(spark, x):
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))


def recall_outside(spark, x, outside, every, **settings):
    got = ann_forest.nearest(table_of(spark, x), k=10, every=every, **settings).collect()
    asked, hits = [q for q in range(0, len(x), every) if outside[q]], 0
    for q in asked:
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(set(np.lexsort((np.arange(len(x)), far))[:10].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    return hits / (10 * len(asked)), got


def test_nearest_recall_with_a_third_of_the_rows_equal(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64))
    same = rng.random(6000) < 1 / 3
    x[same] = x[0]
    recall, got = recall_outside(spark, x, ~same, 100)
    assert recall >= 0.9
    first = np.flatnonzero(same).tolist()
    for q in (q for q in range(0, 6000, 100) if same[q]):
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for i in first if i != q][:10]


@pytest.fixture
def budgets(monkeypatch):
    """The rows that queries were to meet."""
    found, inner = [], ann_forest.measured_budget
    monkeypatch.setattr(ann_forest, "measured_budget", lambda *a: found.append(inner(*a)) or found[-1])
    return found


def clustered(n, rng):
    centres = 10 * rng.normal(size=(n // 100, 32))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 32))


def test_nearest_cost_doesnt_grow_on_clusters(spark, budgets):
    rng = np.random.default_rng(8)
    for n in (5_000, 12_000, 40_000):
        recall, _ = recall_outside(spark, clustered(n, rng), np.ones(n, bool), 400)
        assert recall >= 0.9
    assert max(budgets) <= 1200 and budgets[2] <= 2 * budgets[0] + 200


def test_nearest_without_clusters_and_exact(spark, budgets):
    x = np.random.default_rng(9).normal(size=(11_000, 32))
    recall, _ = recall_outside(spark, x, np.ones(len(x), bool), 250)
    assert recall >= 0.9 and budgets[0] < 8 * len(x)
    recall, _ = recall_outside(spark, x[:2000], np.ones(2000, bool), 100, recall=1.0)
    assert recall == 1.0


def test_large_leaves_are_split(spark, monkeypatch, budgets):
    monkeypatch.setattr(ann_forest, "LEAF_ROWS", 100)
    monkeypatch.setattr(ann_forest, "LEAF_SAMPLE", 300)
    rng = np.random.default_rng(10)
    x = clustered(6_000, rng)
    x[rng.random(6_000) < 1 / 3] = x[0]
    recall, _ = recall_outside(spark, x, (x != x[0]).any(axis=1), 100, sample=500)
    assert recall >= 0.9 and budgets[0] <= 3000


def test_tree_sends_rows_where_it_was_grown():
    x = np.random.default_rng(2).normal(size=(300, 5))
    tree = ann_forest.grow(x, 10, np.random.default_rng(3))
    assert np.bincount(tree.leaf(x), minlength=tree.leaves).max() <= 10
    same = ann_forest.grow(np.ones((50, 5)), 10, np.random.default_rng(3))
    assert same.leaves == 1 and (same.leaf(np.ones((4, 5))) == 0).all()


ODD = [(0, [1.0, 2.0], 1), (100, [1.0, 2.0], 2), (50, [2.0, 1.0], 3), (200, None, 4), (300, [None, 1.0], 5), (400, [float("nan"), 1.0], 6), (500, [float("inf"), 1.0], 7), (None, [1.0, 1.0], 8), (600, [0.0, 0.0], 9), (700, [1.0], 10), (0, [1.0, 2.0], 1), (100, [3.0, 1.0], 4), (1, [-1.0, -0.3], 2), (2, [-1.0, -0.3], 2), (800, [1.0, 1.0, 1.0], 1), (8, [1.0, 2.0, 3.0], 1), (9, [], 1), (10, [0.0, -5.0, 2.0], 1)]


def brute(rows, k, every, score, sign):
    """(query_id, rank, vec_id, score) of each row against each other row of its length."""
    out = []
    for i, (q, x, _) in enumerate(rows):
        if q % every == 0:
            found = sorted((sign * score(x, y), v) for j, (v, y, _) in enumerate(rows) if j != i and len(x) == len(y))[:k]
            out += [(q, r + 1, v, sign * s) for r, (s, v) in enumerate(found)]
    return sorted(out)


def test_vector_edges(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>, v int").withColumn("query_id", F.lit(1)).withColumn("row", F.lit(1)).withColumn("d", F.lit(0))
    part = [r for r in ODD if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all()]
    far = lambda x, y: float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum()))
    dot = lambda x, y: sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(x, y))
    rows = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())
    assert rows(ann_forest.nearest(df)) == brute([r for r in part if any(r[1])], 10, 100, far, 1)
    assert rows(fagin.top_products(df, k=3)) == brute(part, 3, 50, dot, -1)
    for op in (ann_forest.nearest, fagin.top_products):
        assert op(df.where("false")).count() == 0 and op(df.where("vec_id = 50")).count() == 0


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in fagin.top_products(df).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


def test_products_with_a_score_taken_along(spark):
    x = np.random.default_rng(6).integers(-3, 4, (3000, 8)) / 256.0
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in fagin.top_products(table_of(spark, x), k=5, ahead=200).collect())
    y = (x * 256).astype(int)
    expected = []
    for q in range(0, 3000, 50):
        s = y @ y[q]
        first = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:5]
        expected += [(q, r + 1, int(i), int(s[i])) for r, i in enumerate(first)]
    assert got == sorted(expected)


def test_threshold_algorithm_stops_and_is_exact():
    rng = np.random.default_rng(4)
    x = rng.integers(-5, 5, (3000, 6)) * (rng.random((3000, 1)) < 0.1) + rng.integers(-1, 2, (3000, 6))
    lists, ids, early = fagin.SortedLists(x), rng.permutation(3000), 0
    for q in rng.integers(-4, 5, (60, 6)):
        rows, scores, depth = lists.top(q, 5, ids, ids < 0)
        true = x @ q
        expected = np.lexsort((ids, -true))[:5]
        assert ids[rows].tolist() == ids[expected].tolist() and scores.astype(int).tolist() == true[expected].tolist()
        early += depth < 1500
    assert early > 20


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 5, 8):
        runs = [sorted((rng.randint(0, 30), i) for _ in range(rng.randint(0, 40))) for i in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://www.Example.com:443/A?b=2&a=1#top") == "com,example)/a?a=1&b=2"
    assert warc.url_key(None) == "-" and warc.url_key("http://x.org") == "org,x)/"


def test_archives(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "", ""), (9003, "u\r\nX: y", "a\r\n\r\nWARC/1.1\r\n\0"), (9004, "é", "a\r\n\r\nWARC/1.1\r\n\0"), (9004, "é", "a\r\n\r\nWARC/1.1\r\n\0"), (None, "n", "a\r\n\r\nWARC/1.1\r\n\0"), (9005, "big", "x" * (17 << 20))], "page_id long, url string, html string")
    every = pages.select("page_id", "url", "html").unionByName(odd).withColumn("first", F.lit(1)).withColumn("file", F.lit("f"))
    got = warc.captures(every).collect()
    rows = every.collect()
    assert len(got) == len(rows)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for r in rows:
        if r["page_id"] is not None:
            d = digest(r["html"])
            first[d] = min(first.get(d, r["page_id"]), r["page_id"])
    key = lambda t: tuple((x is None, x) for x in t)
    expected = sorted(((r["page_id"], len((r["html"] or "").encode()), digest(r["html"]), "response" if first.get(digest(r["html"])) == r["page_id"] else "revisit", None if first[digest(r["html"])] == r["page_id"] else first[digest(r["html"])]) for r in rows), key=key)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == expected
    order = [(r["urlkey"], r["timestamp"], -1 if r["page_id"] is None else r["page_id"]) for r in got]
    assert order == sorted(order)
    assert warc.captures(every.where("false")).count() == 0
    few = warc.captures(odd, min_revisit_bytes=1).collect()
    assert {r["record_type"] for r in few if r["payload_bytes"] == 0} == {"response"}


def test_archives_are_gzip_and_cut_by_bytes(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    path = warc.write_archives(pages, archive_bytes=5_000)
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).collect()
    assert len(archives) > 5
    count = 0
    for f in archives:
        raw = bytes(f["content"])
        members = [n for _, n, _, _ in warc.read_records(raw)]
        assert len(raw) - members[-1] < 5_000
        count += gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type")
    assert count == pages.count()
    assert warc.name_archives(spark, path) == len(archives)
    rows = warc.merge_runs(warc.capture_runs(spark, path), entries_per_task=50).collect()
    order = [(r["urlkey"], r["timestamp"], r["page_id"]) for r in rows]
    assert order == sorted(order) and len(rows) == count and all(r["file"].endswith(".warc.gz") for r in rows)


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from murmura.llm.common import scratch_root

    other = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x:7077", applicationId="a"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(other)
