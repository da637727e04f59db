"""Token-id files: concatenated ids with Elias-Fano document boundaries and ids.

A file set is a Parquet table of segments (part, seq, before, n_docs, n_ids, payload), before being the ids of earlier segments
of its part. A payload holds a header, the Elias-Fano ends of its documents, those of their doc_ids (less the smallest), and
the ids, two or four bytes each, little-endian. Segments in order of (part, seq) are documents in order of
doc_id, nulls first. Spark's writer puts a segment in place or not at all, on any store that Spark reads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import eliasfano
from docengine.llm import words as W
from docengine.llm.store import tune
from docengine.llm.tokens import encoder

MAGIC = b"DTOK"
#: A segment is closed at so many ids or documents, after the batch of texts that reaches them.
SEGMENT_IDS, SEGMENT_DOCS = 2_000_000, 50_000
_HEAD = "<4sHHQQqQ"
_SCHEMA = "part int, seq int, before long, n_docs long, n_ids long, payload binary"


def pack_segment(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    nulls = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    head = struct.pack(_HEAD, MAGIC, 1, width, len(doc_ids), len(ids), least, nulls)
    rest = (known.astype(np.uint64) - np.uint64(least % (1 << 64))) if len(known) else known
    return head + eliasfano.encode(ends) + eliasfano.encode(rest) + ids.astype("<u2" if width == 2 else "<u4").tobytes()


class Segment:
    """Random access to a payload: ids(i) and doc_id(i) read no table of offsets."""

    def __init__(self, payload: bytes):
        magic, version, self.width, self.n_docs, self.n_ids, self.least, self.nulls = struct.unpack_from(_HEAD, payload)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token segment of version 1")
        self.ends = eliasfano.Reader(payload, struct.calcsize(_HEAD))
        self.known = eliasfano.Reader(payload, self.ends.end)
        self.data = np.frombuffer(payload, "<u2" if self.width == 2 else "<u4", self.n_ids, self.known.end)

    def ids(self, i: int) -> np.ndarray:
        return self.data[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.known.select(i - self.nulls) + self.least


def _write(path: str, end_id: int, most_ids: int, most_docs: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []
        total = before = 0

        def close() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [seq], "before": [before], "n_docs": [len(docs)], "n_ids": [total], "payload": [pack_segment(docs, np.cumsum(sizes), np.concatenate(ids))]})

        for frame in frames:
            texts = frame["text"].tolist()
            names = [None if pd.isna(d) else int(d) for d in frame["doc_id"]]
            for lo, hi in W.batches(texts):
                e = enc.encode(texts[lo:hi])
                last = e.first[1:]
                ids.append(np.insert(e.ids, last, end_id))
                sizes += (np.diff(e.first) + 1).tolist()
                docs += names[lo:hi]
                total += len(ids[-1])
                if total >= most_ids or len(docs) >= most_docs:
                    yield close()
                    docs, sizes, ids, total, before, seq = [], [], [], 0, before + total, seq + 1
        if docs:
            yield close()

    return run


def write(docs: DataFrame, target: str, tokenizer: str, end_id: int, most_ids: int = SEGMENT_IDS, most_docs: int = SEGMENT_DOCS) -> None:
    """Encode every whole text (null: empty), append end_id, and write the segments to `target` in order of doc_id.

    One range shuffle by doc_id, nulls first; rows of one doc_id are ordered by a hash of their text, then by where they were read, so
    that even they are dealt over several ranges where they are many. There are at least as many ranges as the input has
    partitions. Columns other than doc_id and text are ignored; an empty table writes no segment.
    """
    tune(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), source.rdd.getNumPartitions())
    by = [F.col("doc_id").asc_nulls_first(), F.col("th"), F.col("row")]
    dealt = source.withColumns({"th": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(n, *by).sortWithinPartitions(*by)
    dealt.select("doc_id", "text").mapInPandas(_write(tokenizer, end_id, most_ids, most_docs), _SCHEMA).write.parquet(target)


def _read(with_ids: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for base, payload in zip(frame["base"], frame["payload"]):
                s = Segment(payload)
                ends = np.fromiter(map(s.ends.select, range(s.n_docs)), dtype=np.int64, count=s.n_docs)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                wide = s.data.astype("<u4")
                out = {
                    "doc_id": pd.array([s.doc_id(i) for i in range(s.n_docs)], dtype="Int64"), "start": starts + base, "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(wide[a:b]) for a, b in zip(starts, ends)],
                }
                if with_ids:
                    out["ids"] = [wide[a:b].astype(np.int32) for a, b in zip(starts, ends)]
                yield pd.DataFrame(out)

    return run


def read(spark: SparkSession, target: str, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, and its ids if asked for.

    Documents are found by select on the Elias-Fano boundaries. A segment knows the ids before it in its part; those before
    a part come from one total for each part, that is for each task of the writing job, on the driver and in the broadcast.
    """
    segments = spark.read.schema(_SCHEMA).parquet(target)
    totals = sorted((r.part, r.n) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, rows = 0, []
    for part, n in totals:
        rows.append((part, base))
        base += n
    bases = F.broadcast(spark.createDataFrame(rows, "part int, part_base long"))
    located = segments.select("part", "before", "payload").join(bases, "part").select((F.col("before") + F.col("part_base")).alias("base"), "payload")
    return located.mapInPandas(_read(ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
