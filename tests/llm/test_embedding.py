"""Links of the sharded graphs against brute force, above the size at which shards are compared whole."""

import numpy as np
import pytest

from docengine.llm import embedding
from docengine.llm.store import shared_dir

SCHEMA = "vec_id long, embedding array<float>"


def brute(v, ids, least=0.95):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    links, parent = np.zeros(len(v), dtype=int), np.arange(len(v))
    for lo in range(0, len(v), 2000):
        r, c = np.nonzero(u[lo : lo + 2000] @ u.T >= least)
        r += lo
        np.add.at(links, r[r != c], 1)
        parent = embedding.unite(parent, r, c)
    order = np.lexsort((ids, parent))
    low = {int(parent[i]): int(ids[i]) for i in order[::-1]}
    return links, np.array([low[p] for p in parent.tolist()])


def vectors(rng, n, dim, groups, noise):
    base = rng.normal(size=(n, dim))
    parts = [base]
    for size in groups:
        parts.append(rng.normal(size=(1, dim)) + noise * rng.normal(size=(size, dim)))
    v = np.concatenate(parts)
    return v[rng.permutation(len(v))].astype(np.float32)


def test_unite():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 500, 300), rng.integers(0, 500, 300)
    label = embedding.unite(np.arange(500), a, b)
    want = list(range(500))
    for x, y in zip(a, b):
        p, q = want[x], want[y]
        want = [min(p, q) if w in (p, q) else w for w in want]
    assert label.tolist() == want


def test_graph_path(spark):
    """Odd ids, one group of 2000, many small ones: over 128 vectors a shard, so beams search them."""
    rng = np.random.default_rng(4)
    v = vectors(rng, 6000, 32, [2000] + [5] * 1200, 0.12)
    ids = np.arange(len(v)) * 2 + 1
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], SCHEMA)
    before = _edge_rows(spark)
    rows = {r.vec_id: r for r in embedding.near_duplicates(df).collect()}
    links, component = brute(v, ids)
    got = np.array([rows[i].n_links for i in ids.tolist()])
    recall = rows[1].audit_recall
    assert got.sum() >= 0.9995 * links.sum() and (got <= links).all() and recall >= 0.99
    assert np.mean([rows[i].component_id == c for i, c in zip(ids.tolist(), component.tolist())]) >= 0.999
    assert _edge_rows(spark) - before < 3 * 3 * len(v)


def _edge_rows(spark):
    """Rows with an edge that the searches have written so far."""
    try:
        return spark.read.schema("id long, n long, other long").parquet(f"{shared_dir(spark)}/tables/found-*").where("other IS NOT NULL AND id IS NOT NULL").count()
    except Exception:  # no such table yet
        return 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_small_and_odd_rows(spark, kind):
    rng = np.random.default_rng(5)
    v = vectors(rng, 80, 8, [10, 4], 0.05)
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)]
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * 8, 0), (503, [1.0, None] + [0.0] * 6, 0), (504, [float("inf")] + [1.0] * 7, 0), (505, [1.0] * 9, 0)]
    rows += [(None, rows[0][1], 0), (rows[1][0], rows[1][1], 1)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, id int")
    got = embedding.near_duplicates(df).collect()
    assert len(got) == len(rows)
    links, component = brute(v, np.arange(len(v)))
    by = {r.vec_id: r for r in got}
    assert [by[i].component_id for i in range(len(v))] == component.tolist()
    assert [by[i].n_links for i in range(len(v)) if i != 1] == [x for i, x in enumerate(links.tolist()) if i != 1]
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in range(500, 506))
    assert by[None].n_links == 0 and by[None].component_id is None and by[None].kept
    assert embedding.near_duplicates(df.where("false")).count() == 0


def test_double_precision(spark):
    """A pair on either side of the threshold, told apart by doubles alone."""
    c = 0.95
    a = [1.0, 0.0]
    over, under = [c + 1e-12, float(np.sqrt(1 - (c + 1e-12) ** 2))], [c - 1e-12, -float(np.sqrt(1 - (c - 1e-12) ** 2))]
    df = spark.createDataFrame([(1, a), (2, over), (3, under)], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.component_id for r in embedding.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
