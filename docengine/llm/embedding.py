"""Embedding near-dedup over sharded navigable small-world graphs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.components import components
from docengine.llm.hnsw import Graph, M, levels
from docengine.llm.store import table, tune

#: Most vectors of a shard, and most of their components together: with neighbours it has to fit a Python worker.
SHARD_ROWS, SHARD_CELLS = 100_000, 1 << 23
#: First beam; queries of a block whose links decide how wide its beams get, and as many that then measure recall.
BEAM, AUDIT = 32, 128
#: Cells of the table of nodes that a batch of queries has met.
_SEEN = 1 << 25
_SLACK = 1e-4
_GRAPH = "shard int, ord int, id long, copies long, dim int, level int, vec array<double>, near array<int>, root int"


def _unit(rows) -> np.ndarray:
    v = np.stack(rows).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after uniting those of nodes a[i] and b[i]; a label is the smallest node of its set."""
    x, y = label[a], label[b]
    while True:
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = np.flatnonzero(low < high)
        if not len(apart):
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, high[apart], low[apart])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        label, x, y = parent[label], parent[x], parent[y]


def _linked(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray, least: float) -> np.ndarray:
    """Which a[r[i]] and b[c[i]] are alike, in double precision."""
    out = np.zeros(len(r), dtype=bool)
    for lo in range(0, len(r), 1 << 16):
        some = slice(lo, lo + (1 << 16))
        out[some] = np.einsum("ed,ed->e", a[r[some]], b[c[some]]) >= least
    return out


def _build(least: float):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable").reset_index(drop=True)
        level = levels(len(frame), zlib.crc32(repr(key).encode()))
        exact = _unit(frame["vec"])
        g = Graph(exact.astype(np.float32), level)
        near = [np.concatenate([g.layers[k][i] for k in range(level[i] + 1)]) for i in range(len(frame))]
        # links along the graph's edges unite most of a group before the first query
        r, c = np.nonzero(g.layers[0] >= 0)
        c = g.layers[0][r, c].astype(np.int64)
        ok = _linked(exact, exact, r, c, least)
        root = unite(np.arange(len(frame)), r[ok], c[ok])
        return frame.assign(ord=np.arange(len(frame), dtype=np.int32), level=level.astype(np.int32), near=near, root=root.astype(np.int32))[
            ["shard", "ord", "id", "copies", "dim", "level", "vec", "near", "root"]
        ]

    return run


class _Shard:
    """A shard's graph with what its queries of one block have united so far."""

    def __init__(self, frame: pd.DataFrame, least: float):
        level = frame["level"].to_numpy()
        self.exact, self.least = _unit(frame["vec"]), least
        near, layers = frame["near"].tolist(), []
        for k in range(int(level[0]) + 1):
            lo, hi = (0, 2 * M) if k == 0 else (2 * M + (k - 1) * M, 2 * M + k * M)
            layers.append(np.stack([x[lo:hi] for x in near[: int(np.count_nonzero(level >= k))]]))
        self.graph = Graph(self.exact.astype(np.float32), level, layers)
        self.ids, self.copies, self.label = frame["id"].to_numpy(), frame["copies"].to_numpy(), frame["root"].to_numpy().astype(np.int64)
        self.order = np.argsort(self.ids)
        self.width = 0

    def home(self, qids: np.ndarray) -> np.ndarray:
        """The node of each query, -1 if it is in another shard."""
        at = self.order[np.minimum(np.searchsorted(self.ids, qids, sorter=self.order), len(self.ids) - 1)]
        return np.where(self.ids[at] == qids, at, -1)

    def _verified(self, q: np.ndarray, own: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.flatnonzero(own[r] != c)
        keep = keep[_linked(q, self.exact, r[keep], c[keep], self.least)]
        return r[keep], c[keep]

    def links(self, q: np.ndarray, own: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Verified (query, node) pairs that beams of that width find."""
        return self._verified(q, own, *self.graph.within(q.astype(np.float32), self.least - _SLACK, width))

    def all_links(self, q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._verified(q, own, *self.graph.scan(q.astype(np.float32), self.least - _SLACK))

    def audit(self, q: np.ndarray, own: np.ndarray) -> tuple[int, int]:
        """Widens the beam until the first queries miss no link; (true links, those found) of others, which had no say."""
        first, rest, self.width = slice(0, AUDIT), slice(AUDIT, 2 * AUDIT), BEAM
        truth = len(self.all_links(q[first], own[first])[0])
        # what would need a quarter of the nodes is compared with all of them
        while len(self.links(q[first], own[first], self.width)[0]) < truth and 4 * self.width < len(self.ids):
            self.width *= 2
        if not len(q[rest]):
            return 0, 0
        return len(self.all_links(q[rest], own[rest])[0]), len(self.links(q[rest], own[rest], self.width)[0])

    def spanning(self) -> pd.DataFrame:
        return _edges(self.ids, self.ids[self.label])

    def answer(self, q: np.ndarray, qids: np.ndarray) -> Iterator[pd.DataFrame]:
        own = self.home(qids)
        if not self.width:
            true, found = self.audit(q, own)
            yield pd.DataFrame({"id": pd.array([None], dtype="Int64"), "n": [true], "other": pd.array([found], dtype="Int64")})
        r, c = self.links(q, own, self.width)
        n = np.bincount(r, weights=self.copies[c], minlength=len(q)).astype(np.int64)
        full = np.flatnonzero(n)
        if not len(full):
            return
        yield pd.DataFrame({"id": pd.array(qids[full], dtype="Int64"), "n": n[full], "other": pd.array([None] * len(full), dtype="Int64")})
        # a query unites all it links to, its own node too
        order = np.argsort(r, kind="stable")
        r, c = r[order], c[order]
        lead = c[np.searchsorted(r, full)]
        hub = np.full(len(q), -1)
        hub[full] = lead
        mine = full[own[full] >= 0]
        before = self.label
        self.label = unite(before, np.concatenate([c, own[mine]]), np.concatenate([hub[r], hub[mine]]))
        old = np.unique(before[c])
        yield _edges(self.ids[old], self.ids[self.label[old]])
        if len(mine):
            yield _edges(self.ids[before[own[mine]]], self.ids[self.label[own[mine]]])
        away = full[own[full] < 0]
        if len(away):
            yield _edges(qids[away], self.ids[self.label[hub[away]]])


def _edges(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    pair = np.unique(np.stack([a[a != b], b[a != b]], axis=1), axis=0)
    return pd.DataFrame({"id": pd.array(pair[:, 0], dtype="Int64"), "n": 0, "other": pd.array(pair[:, 1], dtype="Int64")})


def _search(least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, shard = None, [], None
        for frame in frames:
            names = ["shard", "dim", "block", "kind"]
            cut = frame[names].ne(frame[names].shift()).any(axis=1).cumsum()
            for _, part in frame.groupby(cut.to_numpy(), sort=False):
                now = tuple(part[["shard", "dim", "block"]].iloc[0])
                if now != key:
                    key, rows, shard = now, [], None
                if part["kind"].iloc[0] == 0:
                    rows.append(part)
                    continue
                if shard is None:
                    if not rows:
                        continue
                    shard = _Shard(pd.concat(rows), least)
                    rows = []
                    if now[2] == 0:
                        yield shard.spanning()
                step = max(2 * AUDIT, min(len(part), _SEEN // len(shard.ids)))
                for lo in range(0, len(part), step):
                    some = part.iloc[lo : lo + step]
                    yield from shard.answer(_unit(some["vec"]), some["id"].to_numpy())

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95, shard_rows: int = SHARD_ROWS, shards: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, audit_recall.

    Vectors link if their cosine in double precision is at least `least`, whatever their label.
    Null, empty or zero vectors and those with null or non-finite components link with nothing, as do
    vectors of unlike dimension; such a vector is its own component. Equal vectors collapse first and count as links of each other.
    Rows that repeat a vec_id are one node and each gets its own row; a null vec_id links with nothing, has a null
    component and is kept. Columns other than vec_id and embedding are ignored; an empty table gives no rows.

    Every distinct vector queries the graph of every shard, in blocks. The first AUDIT queries of a block, in order of a
    hash of vec_id, are also compared with the whole shard, and the beam is doubled until they miss no link; a beam that is more than
    half full of links is widened for that query. Where a beam would take a quarter of a shard's nodes, all of
    them are compared instead: small shards are searched whole. Each found link is verified. audit_recall, one figure for the run, is the share of the true links found for as many
    further queries of each block, which had no say in the beam (null if they have no link).

    A task returns a count for each query that has links, and edges that unite what its queries unite: one for each
    node that graph edges link to another, one for each query of another shard, and one for each set that
    queries join to another. A group of g vectors costs a few rows a vector and shard, not g * g.
    """
    spark = vectors.sparkSession
    tune(spark)
    ok = (
        F.col("embedding").isNotNull()
        & F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    same = table(source.where(ok).groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "distinct")
    total, dim = same.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    n_shards = shards or max(3, -(-total // min(shard_rows, max(1, SHARD_CELLS // dim))))
    nodes = same.select(
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_shards)).cast("int").alias("shard"),
        "id", "copies", F.size("embedding").alias("dim"), F.col("embedding").alias("vec"),
    )
    graph = table(nodes.groupBy("shard", "dim").applyInPandas(_build(least), _GRAPH), "graph")
    # enough blocks of queries for every core, few enough that a graph is not loaded for a handful
    blocks = max(1, min(-(-total // 2000), -(-4 * spark.sparkContext.defaultParallelism // n_shards)))
    block = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int")
    queries = same.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), block.alias("block"), F.lit(1).alias("kind"), F.xxhash64("id", F.lit(3)).alias("ord"),
        "id", "copies", F.size("embedding").alias("dim"), F.lit(0).alias("level"), F.col("embedding").alias("vec"), F.lit(None).cast("array<int>").alias("near"), F.lit(0).alias("root"),
    )
    every = graph.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "kind": F.lit(0), "ord": F.col("ord").cast("long")})
    work = every.select(*queries.columns).union(queries).repartition(2 * n_shards * blocks, "shard", "dim", "block")
    work = work.sortWithinPartitions("shard", "dim", "block", "kind", "ord")
    found = table(work.mapInPandas(_search(least), "id long, n long, other long"), "found")
    true, seen = found.where("id IS NULL").agg(F.sum("n"), F.sum("other")).first()
    found = found.where("id IS NOT NULL")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    members = source.where(ok).join(same, "embedding").select("vec_id", "id", "copies")
    edges = found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
    group = components(edges.union(members.select("id", "vec_id"))).withColumnRenamed("node", "vec_id")
    linked = members.join(counts, "id", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    linked = linked.groupBy("vec_id").agg(F.max("n").alias("n"))
    out = source.select("vec_id").join(linked, "vec_id", "left").join(group, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        F.lit(seen / true if true else None).cast("double").alias("audit_recall"),
    )
