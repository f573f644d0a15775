"""Embeddings and URLs: brute force and awkward rows; the pipeline."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.llm import components, hnsw, url_tree

from .helpers import SCHEMA, awkward_rows, prose


def brute_vectors(rows, cosine=0.93):
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, low = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    pairs = []
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    pairs.append((a[0], b[0]))
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return links, low


def vector_rows():
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=16))], i % 3) for i in range(300)]
    centre = np.float32(rng.normal(size=16))
    rows += [(300 + i, [float(x) for x in np.float32(centre + 0.12 * rng.normal(size=16))], 1) for i in range(150)]
    rows += [(500 + i, rows[5][1], 2) for i in range(40)]  # copies
    nan = float("nan")
    return rows + [(600, None, 1), (601, [0.0] * 16, 1), (602, [nan] + [1.0] * 15, 1), (603, [None] + [1.0] * 15, 1), (604, rows[0][1], None), (605, [float("inf")] * 16, 1), (606, [], 1), (607, [1.0, 2.0], 1), (608, [2.0, 4.0], 1)]


@pytest.mark.parametrize("capacity", [4096, 40])
def test_hnsw_equals_brute_force(spark, capacity):
    rows = vector_rows()
    links, low = brute_vectors(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("print", F.lit("x")).withColumn("home", F.lit(0))
    found = {r.vec_id: r for r in hnsw.near_duplicates(df, capacity=capacity).collect()}
    assert len(found) == len(rows)
    missed = sum(links[k] - found[k].n_links for k in links)
    assert all(found[k].n_links <= links[k] for k in links) and missed <= 0.01 * sum(links.values())
    assert sum(found[k].component_id != low[k] for k in low) <= 2
    assert all(found[k].kept == (found[k].component_id == k) for k in low)


@pytest.mark.parametrize("capacity", [4096, 40])
def test_hnsw_counts_links_found_from_one_side(spark, monkeypatch, capacity):
    whole = hnsw.within

    def one_way(graph, x, queries, beam, cosine, own=None):
        found = whole(graph, x, queries, beam, cosine, own)
        # of two shards only one visits the other: there a pair has one chance by design
        return found if own is None else [f[x[f][:, 0] <= q[0] + 1e-9] for f, q in zip(found, queries)]

    monkeypatch.setattr(hnsw, "within", one_way)
    monkeypatch.setattr(hnsw, "BLOCK", 16)
    rows = vector_rows()
    links, low = brute_vectors(rows)
    found = {r.vec_id: r for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), capacity=capacity).collect()}
    assert {k: r.n_links for k, r in found.items()} == links and {k: r.component_id for k, r in found.items()} == low


def many_vectors(n=6000, d=24):
    """One label: clusters of a few to hundreds of near vectors between as many that stand alone."""
    rng = np.random.default_rng(8)
    x = [rng.normal(size=(n // 2, d))]
    while sum(map(len, x)) < n:
        x.append(rng.normal(size=d) + rng.uniform(0.1, 0.3) * rng.normal(size=(int(rng.choice([2, 5, 20, 200])), d)))
    return np.float32(np.concatenate(x)[:n])


@pytest.mark.parametrize("capacity", [4096, 1000])
def test_hnsw_graphs_equal_brute_force(spark, capacity):
    x = many_vectors()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(8)
    found = {r.vec_id: r for r in hnsw.near_duplicates(df, capacity=capacity).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = u @ u.T >= 0.93
    np.fill_diagonal(links, False)
    low, (i, j) = np.arange(len(x)), np.nonzero(links)
    low = hnsw.merged(low, i, j)
    got = np.array([found[k].n_links for k in range(len(x))])
    assert (got <= links.sum(1)).all() and got.sum() >= 0.999 * links.sum()
    assert np.mean([found[k].component_id == low[k] for k in range(len(x))]) >= 0.999


def test_graph_answers_without_comparing_all():
    x = many_vectors(2500).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    for members in (True, False):
        beam, recall = hnsw.audited(graph, x, 0.93, members)
        assert beam < len(x) / 4 and recall >= 0.999
        got = hnsw.within(graph, x, x, beam, 0.93, np.arange(len(x)) if members else None)
        assert all(len(np.unique(f)) == len(f) for f in got)
        assert sum(map(len, got)) >= 0.998 * (x @ x.T >= 0.93).sum()


def test_hnsw_ids_that_share_vectors(spark):
    a, b, c = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, 0), (1, b, 0), (2, c, 0), (2, c, 0), (None, a, 0)]
    found = sorted((r.vec_id or 0, r.n_links) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert found == [(0, 2), (1, 2), (1, 2), (2, 1), (2, 1)]


def test_hnsw_empty(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_graph_recall():
    x = np.random.default_rng(2).normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    near, _ = graph.search(x[:200], 96)
    truth = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(np.intersect1d(a, b)) / 10 for a, b in zip(near, truth)]) > 0.9


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path


def plain_rule(host, path):
    fit = [(h + p, v) for v, h, p in url_tree.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


def test_urls(spark):
    rnd = random.Random(8)
    hosts = ["net", "Example.NET", "a.example.net", "xexample.net", "example.com", "b.example.com", "x.org", "ÉX.org", "io"]
    rows = [(i, f"{rnd.choice(['http', 'HTTPS', ''])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en/5', '/de/7', '/fr/9.html', '/fr', '?q=/en/', '#x'])}{rnd.choice(['', '?a=b/c', '#f?g'])}") for i in range(200)]
    rows += [(900, None), (901, ""), (902, "no scheme"), (903, "a://b://c/d"), (904, "://"), (None, "http://x.org/fr/1"), (905, "http://x.org/" + "seg/" * 3000), (905, "http://x.org/" + "seg/" * 3000), (906, "http://h\ni.org/fr/\n?x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("q")).withColumn("shape", F.lit(1))
    labels = spark.createDataFrame([(5, 1), (7, 0), (7, None), (None, 1)], "page_key long, bad int")
    found = url_tree.judge_urls(pages, labels).collect()
    want = sorted([(i, *plain_url(u)) for i, u in rows], key=repr)
    assert sorted([(r.page_id, r.host, r.path) for r in found], key=repr) == want
    for r in found:
        rule, verdict = plain_rule(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert url_tree.judge_urls(pages.limit(0), labels).count() == 0


def test_url_templates_block_bad_branches(spark):
    pages = [(i, f"http://h.io/{'spam' if i % 2 else 'news'}/{i}") for i in range(400)]
    labels = [(i, int(i % 2)) for i in range(0, 400, 3)] + [(i, int(i % 2)) for i in range(1, 400, 4)]
    found = url_tree.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_key long, bad int"))
    verdicts = {(r.template, r.verdict) for r in found.collect()}
    assert {v for t, v in verdicts if "spam" in t} == {"block"} and {v for t, v in verdicts if "news" in t} == {"allow"}


def judged(spark, pages, labels):
    found = url_tree.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_key long, bad int"), rules=())
    return {r.page_id: r.verdict for r in found.collect()}


def test_url_tree_reaches_deep_branches(spark):
    deep = "/".join(["d"] * 40)
    where = {0: "a/b/c/news", 1: "a/b/c/news", 2: "a/b/c/news", 3: "a/b/c/spam", 4: f"{deep}/x/ok", 5: f"{deep}/x/ok", 6: f"{deep}/x/bad", 7: f"{deep}/y/ok"}
    pages = [(i, f"http://h.io/{where[i % 8]}/{i}") for i in range(800)]
    verdicts = judged(spark, pages, [(i, int(i % 8 in (3, 6))) for i in range(800)])
    assert verdicts == {i: "block" if i % 8 in (3, 6) else "allow" for i in range(800)}


def test_url_tree_keeps_branches_with_opposite_children_apart(spark):
    pages = [(i, f"http://h.io/{'ab'[i % 2]}/{'xy'[i // 2 % 2]}/{i}") for i in range(400)]
    bad = {i: int(i % 2 == i // 2 % 2) for i in range(400)}
    assert judged(spark, pages, list(bad.items())) == {i: "block" if bad[i] else "allow" for i in bad}


def test_url_tree_keeps_a_small_bad_section(spark):
    sections = ["".join("abcdefgh"[i // 8**k % 8] for k in range(3)) for i in range(60)]
    pages = [(i, f"http://h.io/{sections[i % 60]}/{i}") for i in range(1200)]  # 20 pages a section, under 2 % and fewer than sections
    verdicts = judged(spark, pages, [(i, int(i % 60 == 7)) for i in range(0, 1200)])
    assert verdicts == {i: "block" if i % 60 == 7 else "allow" for i in range(1200)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = awkward_rows() + [(1000 + i, prose(i, 80), "en", f"s{i % 4}", 1) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        counts[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
            assert {r.doc_id for r in docs.collect()} <= {r[0] for r in rows}
    assert counts["toxicity"] == len(rows) > counts["language_id"] > counts["ngram_jaccard"], json.dumps(counts)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts["packing"]


def test_only_hot_shapes_are_copied(spark):
    rows = [(i, f"http://a.com/news/{'x' * (i % 40)}-story-{i}") for i in range(600)] + [(1000 + i, "http://hot.com/same") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([], "page_key long, bad int")
    host, path = url_tree.host_and_path(F.col("url"))
    shapes = pages.select(host.alias("host"), url_tree.shape(path).alias("shape")).groupBy("host", "shape").count().withColumnRenamed("count", "n")
    hot = url_tree.hot_shapes(shapes).collect()
    assert 1 <= len(hot) <= url_tree.HOT and "hot.com" in {r.host for r in hot}
    assert url_tree.hot_shapes(shapes.limit(0)).count() == 0
    out = url_tree.judge_urls(pages, labels)
    assert out.count() == 1000 and {r.verdict for r in out.collect()} == {"allow"}
