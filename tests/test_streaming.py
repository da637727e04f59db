"""Uploads as a stream: what is refused, what repeats, and a second start."""

from pyspark.sql import functions as F

from docengine.sources.documents import literal_text
from docengine.streaming import ingest


def test_uploads(spark, tmp_path):
    folder, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    body = b"%PDF-1.4\nBT (Hello) Tj ET"
    for name, content in (("a.pdf", body), ("b.pdf", body), ("c.pdf", b"nope"), ("d.txt", body), ("e.pdf", b"")):
        (tmp_path / "in" / name).write_bytes(content)

    def once():
        stream = ingest.uploads(spark, folder)
        ingest.run(stream, lambda df: df.select("sha256", literal_text(F.col("content")).alias("text")), target, mark).awaitTermination(60)
        return spark.read.parquet(target).select("text").collect()

    assert [r.text for r in once()] == ["Hello"]
    (tmp_path / "in" / "f.pdf").write_bytes(body + b" (again) Tj")
    assert sorted(r.text for r in once()) == ["Hello", "Hello\nagain"]
