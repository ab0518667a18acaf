import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from veriplumb.llm import vecdup
from veriplumb.llm.queries import op10_vectors

from .cases import SF, documents, empty


def brute(rows, least=0.98):
    x = {}
    for k, (_, v, label) in enumerate(rows):
        ok = label is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        x[k] = np.array(v, float) / np.abs(v).max() if ok else None
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if x[a] is not None and x[b] is not None and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= least:
                links[a] += 1
                links[b] += 1
                up[max(find(a), find(b))] = min(find(a), find(b))
    least_id = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least_id[find(k)] = min(least_id.get(find(k), r[0]), r[0])
    return sorted(((r[0], links[k], least_id.get(find(k)), r[0] == least_id.get(find(k))) for k, r in enumerate(rows)), key=repr)


def sample(rng, n, d=8):
    centre = rng.normal(size=(6, d))
    return [(i, (centre[i % 6] + (0.12 if i % 2 else 1.5) * rng.normal(size=d)).astype(np.float32).tolist(), i % 3) for i in range(n)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limits", [{}, {"WHOLE": 40, "PER_CENTRE": 30}, {"SHARD": 50}, {"WHOLE": 40, "PER_CENTRE": 40, "SHARD": 40}])
def test_against_all_pairs(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(vecdup, k, v)
    rows = sample(np.random.default_rng(1), 400)
    want, found = brute(rows), got(vecdup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")))
    assert [r[0] for r in found] == [r[0] for r in want]
    assert sum(r[1] for r in found) >= 0.97 * sum(r[1] for r in want) and all(a[1] <= b[1] for a, b in zip(found, want, strict=True))
    if not {"WHOLE"} & set(limits):
        assert found == want


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0), (8, [1.0, None], 0),
        (9, [nan, 1.0], 0), (10, [inf, 1.0], 0), (None, [1.0, 0.01], 0), (None, [0.0, 1.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1e-30, 0.0], 0), (13, [-1.0, 0.0], 0), (14, [3e38, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "7 as row", "8 as node", "9 as vector")
    assert got(vecdup.near_vectors(df)) == brute(rows)
    assert vecdup.near_vectors(df.limit(0)).count() == 0


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(op10_vectors(spark, SF)) == brute(rows)


def test_search_and_audit_of_a_tight_group():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(1, 32)) + 0.02 * rng.normal(size=(300, 32)), rng.normal(size=(500, 32))])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    near, medoid = vecdup.build(x.astype(np.float32))
    true = x @ x.T >= 0.98
    np.fill_diagonal(true, False)
    found = vecdup.in_range(x.astype(np.float32), x, near, medoid, 0.98)
    assert not (found & ~true).any() and found.sum() >= 0.99 * true.sum()


def group_and_others(n, others, d=64):
    """Unit vectors: one group of near copies, a looser one of which just some link, and others."""
    rng = np.random.default_rng(4)
    noise = np.full(n, 0.11)
    noise[n - others - 600 :] = 0.142
    x = rng.normal(size=(2, d))[(np.arange(n) >= n - others - 600).astype(int)]
    x = x / np.linalg.norm(x, axis=1)[:, None] + noise[:, None] * rng.normal(size=(n, d)) / np.sqrt(d)
    x[n - others :] = rng.normal(size=(others, d))
    return (x / np.linalg.norm(x, axis=1)[:, None])[rng.permutation(n)]


def links_and_components(x, least=0.98):
    links = x @ x.T >= least
    np.fill_diagonal(links, False)
    comp = np.arange(len(x))
    while True:
        low = np.array([min(c, comp[r].min(initial=c)) for c, r in zip(comp, links, strict=True)])
        if (low == comp).all():
            return links.sum(axis=1).tolist(), comp.tolist()
        comp = low


def frame(spark, x):
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x)), "label": np.zeros(len(x), np.int64)}))


def found_of(df):
    rows = sorted(df.select("vec_id", "n_links", "component_id").collect())
    return [r[1] for r in rows], [r[2] for r in rows]


def test_every_pair_in_range_meets_at_home():
    x = group_and_others(3000, 900, 12)
    for least in (0.98, 0.8):
        for c in (x[:40], x[::100], x[-25:], np.repeat(x[:3], 2, axis=0)):
            home, goes = vecdup.cells(x, c, least)
            u, v = np.nonzero(x @ x.T >= least)
            shard = np.minimum(home[u], home[v])
            assert goes[u, shard].all() and goes[v, shard].all()


@pytest.mark.parametrize("n", [4500, 12_000])
def test_one_group_of_near_copies_over_many_centres(spark, n):
    x = group_and_others(n, 300)
    assert found_of(vecdup.near_vectors(frame(spark, x))) == links_and_components(x)


def test_audit_of_labels_finds_links_lost_between_shards(spark, monkeypatch):
    cells = vecdup.cells

    def home_only(x, c, least):
        home, goes = cells(x, c, least)
        return home, goes & (np.arange(len(c)) == home[:, None])

    monkeypatch.setattr(vecdup, "cells", home_only)
    monkeypatch.setattr(vecdup, "thinned", lambda x, c, n, least: c)
    x = group_and_others(4500, 300)
    assert found_of(vecdup.near_vectors(frame(spark, x))) == links_and_components(x)


def random_and_copies(n, d=32, seed=6):
    """Random unit vectors; a tenth are near another, on both sides of the limit, and some equal to one."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    k = n // 10
    off = rng.normal(size=(k, d)) / np.sqrt(d)
    x[:k] = x[k : 2 * k] + rng.uniform(0.02, 0.25, (k, 1)) * off
    x[-20:] = x[40:60]
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_groups_by_sketches():
    for x in (random_and_copies(4000), group_and_others(4000, 900, 12), np.eye(1, 16).repeat(2500, 0) + 0.2 * random_and_copies(2500, 16)):
        x = vecdup.unit(x)
        for least in (0.98, 0.6):
            want = vecdup._compared(x.astype(np.float32), np.arange(len(x)), np.arange(len(x)), least - 1e-4)[0]
            assert vecdup.close_groups(x.astype(np.float32), least).tolist() == want.tolist()
    for n, least in ((5000, 0.98), (60_000, 0.98), (1_000_000, 0.9)):
        bits, tables = vecdup.sketch_size(n, 64, least)
        assert tables and (1 - (1 - np.arccos(least) / np.pi) ** bits) ** tables <= vecdup.LOST
    assert vecdup.sketch_size(2000, 64, 0.0) == (0, 0)


@pytest.mark.parametrize("held", [vecdup.HELD, 60_000])
def test_nodes_without_links_go_to_no_shard(spark, monkeypatch, held):
    monkeypatch.setattr(vecdup, "HELD", held)
    x, audit = random_and_copies(7000), []
    assert found_of(vecdup.near_vectors(frame(spark, x), audit=audit)) == links_and_components(x)
    assert sum(r["groups"] for r in audit if r["way"] in ("graph", "blocks")) == 1 and audit[-1] == {"way": "labels compared whole", "groups": 0, "audited": 1, "missed": 0}


def test_links_that_the_graph_misses_of_any_node_are_added():
    x = random_and_copies(800)
    zero = np.zeros(len(x), np.int64)
    lists = [[(i + 1) % 400] if i < 400 else [] for i in range(len(x))]  # half the nodes are out of the search's reach
    task = pa.RecordBatch.from_pydict({**dict.fromkeys(("label", "shard", "low", "high", "side", "home"), zero), "node": np.arange(len(x)), "copies": zero + 1, "vector": list(x), "neighbours": lists})
    (found,) = vecdup._search(0.98)(iter([task]))
    assert (found["links"].to_pylist(), found["root"].to_pylist()) == links_and_components(x)
    assert found["way"][0].as_py() == "graph" and found["missed"][0].as_py() > 0


def test_label_that_sketches_fail_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(vecdup, "groups_of", lambda nodes, sizes, least: nodes.selectExpr("node", "node as root").limit(0))
    x, audit = random_and_copies(2500), []
    x[:1200] = x[:1] + 0.01 * x[1200:2400]
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert found_of(vecdup.near_vectors(frame(spark, x), audit=audit)) == links_and_components(x)
    assert audit[-1]["groups"] == 1


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixing", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = corpus_pipeline.staged(docs)
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}, name
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert kept[0] <= ids and len(kept[0] & bad) <= 0.1 * len(bad) and len(kept[0] & good) >= 0.95 * len(good)
    assert len(kept[1]) >= 0.98 * len(kept[0]) and kept[2] < kept[1] and kept[3] <= kept[2]
    packed = corpus_pipeline.packed(spark, docs, SF)
    assert packed.count() >= docs.count()
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept[3]


def test_pipeline_on_cases_and_nothing(spark):
    for docs in (documents(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.staged(stage(spark, docs, SF))
        assert docs.count() >= 0


def with_planted_copies(rng, sizes, d=64):
    """Labels of random vectors, of which one in five has copies nearby: cosines on both sides of the limit."""
    xs, labels = [], []
    for label, n in enumerate(sizes):
        x = rng.normal(size=(n, d))
        x /= np.linalg.norm(x, axis=1)[:, None]
        base = rng.choice(n, n // 5, replace=False)
        for k in rng.permutation(n)[: n // 3]:
            v = x[base[k % len(base)]] + rng.uniform(0.05, 0.25) * rng.normal(size=d) / np.sqrt(d)
            x[k] = v / np.linalg.norm(v)
        xs.append(x)
        labels += [label] * n
    return np.concatenate(xs), np.array(labels)


def test_recall_on_planted_copies_at_several_sizes(spark):
    x, labels = with_planted_copies(np.random.default_rng(8), (300, 1800, 4000))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x)), "label": labels}))
    audit = []
    got = np.array(found_of(vecdup.near_vectors(df, audit=audit))[0])
    want = np.zeros(len(x), int)
    for k in set(labels.tolist()):
        own = np.flatnonzero(labels == k)
        links = x[own] @ x[own].T >= 0.98
        want[own] = links.sum(axis=1) - 1
    assert (got <= want).all() and want.sum() > 1000 and got.sum() >= 0.99 * want.sum()
    by = {r["way"]: r for r in audit}
    assert by["graph"]["groups"] >= 3 and by["graph"]["audited"] > 0 and by["graph"]["missed"] == 0 and by["labels compared whole"]["groups"] == 0
