"""Best-fit packing with dual-feasible-function certificates and exchange between partitions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm import words as W
from docengine.llm.store import table, tune
from docengine.llm.tokens import encoder

#: Pieces that one task packs at once.
PART_ROWS = 50_000
ROUNDS = 5
#: A sequence with less free space than this share of its size is not opened again.
SLACK = 0.002
#: Reruns of a partition that its bound does not certify, in perturbed order.
RERUNS, SHAKE = 4, 0.15


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The least bins that pieces of these lengths can need."""
    return bound_of(np.bincount(lengths, minlength=size + 1), size)


def bound_of(counts: np.ndarray, size: int) -> int:
    """The best of the bounds by the dual feasible functions f_eps and u_k of Fekete and Schepers, for counts[x] pieces of length x.

    Each maps lengths so that what fits a bin sums to at most 1, hence the rounded-up sum over all pieces bounds the bins.
    """
    n = counts.astype(np.int64)
    x = np.arange(size + 1)
    best = -(-int((n * x).sum()) // size)
    above, volume = np.cumsum(n[::-1])[::-1], np.concatenate([[0], np.cumsum(n * x)])
    for eps in range(1, size // 2 + 1):
        # over size - eps: a whole bin; under eps: nothing
        whole = int(above[size - eps + 1]) if size - eps + 1 <= size else 0
        middle = int(volume[size - eps + 1] - volume[eps])
        best = max(best, whole + -(-middle // size))
    for k in range(1, 41):
        exact = (x * (k + 1)) % size == 0
        # u_k(x) = x if (k + 1) x is whole, else floor((k + 1) x) / k; times k * size to stay in integers
        value = np.where(exact, x * k, (x * (k + 1) // size) * size)
        best = max(best, -(-int((n * value).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int, order: np.ndarray | None = None) -> np.ndarray:
    """The bin of each piece, longest first (or by `order`) into the fullest bin that it fits; ties by place."""
    out = np.zeros(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    mask, bins = 0, 0
    for i in (np.argsort(-lengths, kind="stable") if order is None else order).tolist():
        n = int(lengths[i])
        fit = mask >> n
        if fit:
            gap = n + (fit & -fit).bit_length() - 1
            b = free[gap].pop()
            if not free[gap]:
                mask &= ~(1 << gap)
        else:
            gap, b, bins = size, bins, bins + 1
        left = gap - n
        if left:
            free[left].append(b)
            mask |= 1 << left
        out[i] = b
    return out


def rerun(lengths: np.ndarray, bins: np.ndarray, size: int, bound: int) -> np.ndarray:
    """`bins`, or those of fewer bins that reruns find: pieces of bins with free space are packed again, longest first but for a
    perturbation, until the bound is met or RERUNS have passed."""
    rng = np.random.default_rng(len(lengths))
    for _ in range(RERUNS):
        n = int(bins.max()) + 1
        if n == bound:
            break
        free = size - np.bincount(bins, weights=lengths, minlength=n)
        again = np.flatnonzero(free[bins] > 0)
        some = lengths[again]
        other = best_fit(some, size, np.argsort(-some * (1 + SHAKE * rng.random(len(some))), kind="stable"))
        keep, full = np.unique(bins[free[bins] == 0], return_inverse=True)
        if len(keep) + int(other.max(initial=-1)) + 1 < n:
            bins = bins.copy()
            bins[free[bins] == 0] = full
            bins[again] = len(keep) + other
    return bins


def _pieces(path: str, end_id: int, size: int, with_ids: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, row = encoder(path), 0
        for frame in frames:
            texts, names = frame["text"].tolist(), frame["doc_id"].tolist()
            for lo, hi in W.batches(texts):
                e = enc.encode(texts[lo:hi])
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "row", "ids")}
                for d in range(hi - lo):
                    ids = np.append(e.ids[e.first[d] : e.first[d + 1]], end_id).astype("<u4")
                    for piece, at in enumerate(range(0, len(ids), size)):
                        part = ids[at : at + size].tobytes()
                        name = names[lo + d]
                        for k, v in zip(out, (None if pd.isna(name) else int(name), piece, at, len(part) // 4, zlib.crc32(part), row, part)):
                            out[k].append(v)
                    row += 1
                if not with_ids:
                    del out["ids"]
                yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    return run


def _pack(size: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "row", "ids_crc32"], kind="stable", ascending=[False, True, True, True, True]).reset_index(drop=True)
        lengths = frame["length"].to_numpy()
        bound = lower_bound(lengths, size)
        bins = rerun(lengths, best_fit(lengths, size), size, bound)
        n = int(bins.max()) + 1
        fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        order = np.lexsort((np.arange(len(bins)), bins))
        running = np.cumsum(lengths[order])
        head = np.concatenate([[0], np.cumsum(fill)])[bins[order]]
        offset = np.empty(len(bins), dtype=np.int64)
        offset[order] = running - lengths[order] - head
        # a certified partition keeps its bins but for the emptiest, which no bound of a part can judge; another gives up all with space
        loose = size - fill > SLACK * size
        if n == bound:
            loose &= np.arange(n) == fill.argmin()
        stay = ~loose[bins]
        kept = lower_bound(lengths[stay], size) == n - int(loose.sum())
        return frame.assign(bin=bins, offset=offset, loose=loose[bins], certified=np.where(stay, kept, False), whole=n == bound)

    return run


def certificate(packed: DataFrame, size: int = 4096) -> dict[str, int]:
    """sequences of a packing, and the lower bound of all its pieces together; `size` + 1 counts come to the driver."""
    return {"sequences": packed.where("offset = 0").count(), "bound": _bound(packed, size)}


def _bound(pieces: DataFrame, size: int) -> int:
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return bound_of(counts, size)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096, ids: bool = False, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified, and its ids if asked for.

    A document is its whole text's ids (null: empty) and end_id; only a document longer than
    `size` is cut. Pieces are dealt over partitions of about `part_rows` and packed there by best-fit decreasing, with reruns while
    the bound of a partition's pieces does not certify its number of bins. A certified partition keeps its bins but for the
    emptiest; one with a gap gives up all bins with free space. What is given up meets that of other partitions and is
    packed again, until the bound of all pieces is met, nothing is given up, one partition is left, or ROUNDS
    have passed. certified tells that the bins that a partition has kept are the fewest for their pieces; `certificate` gives
    the number of sequences and the bound of all pieces. Every piece is placed once, offsets leave no gap. Null doc_ids and
    repeated rows are packed like any others; other columns are ignored; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_ = table(source.mapInPandas(_pieces(tokenizer, end_id, size, ids), columns + ", ids binary" * ids), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
    left, placed, closed = all_.select(*names), [], 0
    bound = _bound(all_, size)
    for r in range(ROUNDS):
        rows = left.count()
        if not rows:
            break
        parts = max(1, -(-rows // part_rows))
        part = F.pmod(F.xxhash64("doc_id", "piece", "row", "ids_crc32", F.lit(r)), F.lit(parts)).cast("int")
        packed = left.withColumn("part", part).groupBy("part").applyInPandas(_pack(size), columns + ", part int, bin long, offset long, loose boolean, certified boolean, whole boolean")
        packed = table(packed, "packed")
        number = F.lit(r << 60 if r < 8 else 0).cast("long") + F.col("part").cast("long") * F.lit(1 << 32) + F.col("bin")
        bins, given = packed.where("offset = 0").agg(F.count("*"), F.count_if("loose")).first()
        last = r == ROUNDS - 1 or parts == 1 or closed + bins == bound
        closed += bins - given
        stay = packed if last else packed.where("NOT loose")
        placed.append(stay.select(*names, number.alias("sequence_id"), "offset", (F.col("whole") if last else F.col("certified")).alias("certified")))
        if last:
            break
        left = packed.where("loose").select(*names)
    if not placed:
        placed.append(all_.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified")))
    out = placed[0]
    for more in placed[1:]:
        out = out.union(more)
    if ids:
        same = [out["doc_id"].eqNullSafe(all_["doc_id"]), *(out[c] == all_[c] for c in ("piece", "row", "ids_crc32"))]
        out = out.join(all_, same).select(*(out[c] for c in out.columns), all_["ids"]).dropDuplicates(["sequence_id", "offset"])
    return out.drop("row")
