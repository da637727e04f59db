"""Stages of the pipeline on rows that the driver's tables do not hold, and the whole of it against plain Python."""

import random
import re
import zlib
from collections import defaultdict

import public_tokenizers as P

import corpus_pipeline
from docengine.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_keep_distinct(spark):
    """One row of each text stays, whatever ids are null or repeated."""
    rows = [(None, "a"), (None, "b"), (None, "b"), (None, None), (None, ""), (5, "A"), (5, "B"), (9, "B"), (7, "c"), (7, "d"), (7, "d"), (8, "a")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    got = corpus_pipeline.keep_distinct(spark, docs, "").collect()
    assert sorted((r.text or "", r.doc_id or 0) for r in got) == [("", 0), ("A", 5), ("B", 9), ("a", 8), ("b", 0), ("c", 7), ("d", 7)]
    assert got[0].asDict().keys() == set(corpus_pipeline.COLUMNS)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, tmp_path):
    """Each stage on what the one before kept: exact copies, near copies, personal data, pieces of sequences."""
    from tokenizers import Tokenizer

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    texts = []
    for _ in range(40):
        ws = [word() for _ in range(rnd.randint(30, 120))]
        texts.append(" ".join(ws))
        if rnd.random() < 0.5:
            texts.append(texts[-1])
        if rnd.random() < 0.5:
            ws[rnd.randrange(len(ws))] = "changed"
            texts.append(" ".join(ws) + (" mail x.y@z.org" if rnd.random() < 0.3 else ""))
    texts += [f"{word()} %%% ### $$$ &&& {word()} !!! ***" * 8 for _ in range(30)] + ["a" * 9000 + " " + "b c " * 6000, "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 0 if "%%%" in (t or "") else 1, 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            seen.append({r.doc_id: r.text for r in docs.collect()})
    all_, good, distinct, apart, clean = seen
    model = quality.train(spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 5], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r.doc_id for r in quality.score(spark.createDataFrame(rows, SCHEMA), model).collect() if r.predicted}
    assert set(good) == kept and not any("%%%" in (t or "") for t in good.values()) and len(good) > 50
    groups = defaultdict(list)
    for i, t in good.items():
        groups[t or ""].append(i)
    assert set(distinct) == {max(g) for g in groups.values()}
    sets = {i: shingles(t) for i, t in distinct.items()}
    parent = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((parent[i], parent[j]))
                parent = {k: a if v == b else v for k, v in parent.items()}
    assert set(apart) == {i for i, p in parent.items() if i == p}
    assert set(clean) == set(apart) and not any("x.y@z.org" in (t or "") for t in clean.values())
    assert all(clean[i] == t for i, t in apart.items() if "@" not in (t or ""))
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    length = defaultdict(int)
    fill = defaultdict(int)
    for r in docs.collect():
        length[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert length == {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in clean.items()}
    assert max(fill.values()) <= 4096
