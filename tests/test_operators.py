"""Literal rows for branches that the driver's tables do not reach."""

from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import clean, jobs, layout, tables, validate
from docengine.sources.documents import literal_stream, literal_text, read_results, upload_error, write_results


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_noise(spark):
    lines = ["###---###", "aaaaaaa", "", "  ", "-----", "Page 3 of 9", "સરકારી ઠરાવ", "हिन्दी पाठ", "Plain line", "no 100000 run", "...", "AaAaAb x"]
    got = col(spark, lines, T.is_noise)
    assert got == [True, True, True, True, True, True, False, False, False, True, True, True]


def test_lines_and_strip(spark):
    assert col(spark, ["a\r\nb\n", "", "x y"], T.split_lines) == [["a", "b"], [], ["x", "y"]]
    assert col(spark, ["\t a  "], T.strip) == ["a"]


def test_duplicates(spark):
    long = "this is quite a long line of text that repeats itself number"
    rows = [(1, i, t) for i, t in enumerate(["Government", "GOVERNMENT", long + " 1", long + " 2", "other"])]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, line string")
    assert {r.line_no for r in clean.drop_exact(df, ["doc_id"], ["line_no"]).collect()} == {0, 2, 3, 4}
    assert {r.line_no for r in clean.drop_near(df, ["doc_id"]).collect()} == {0, 2, 4}


def test_headers(spark):
    pages = spark.createDataFrame([(1, p, f"Head\nbody {p}") for p in (1, 2, 3)], "doc_id int, page int, text string")
    assert {r.text for r in clean.clean_pages(pages).collect()} == {"body 1", "body 2", "body 3"}


def test_stitch(spark):
    pages = spark.createDataFrame([(1, 1, "adminis", None), (1, 2, "tration act.", 0.3), (1, 3, "", 0.9)], "doc_id int, page int, text string, confidence double")
    got = {r.page: r.text for r in validate.stitch(pages).collect()}
    assert got == {1: "adminis tration act.", 2: "", 3: ""}
    report = validate.document_confidence(pages).first()
    assert report.confidence == 0.7167


def test_reading_order(spark):
    rows = [(1, 0, 300.0, 101.0, 350.0, 110.0, "B"), (1, 1, 10.0, 100.0, 60.0, 110.0, "A"), (1, 2, 10.0, 200.0, 60.0, 210.0, "C")]
    b = spark.createDataFrame(rows, "page int, ord int, x0 double, y0 double, x1 double, y1 double, text string")
    assert [r.text for r in layout.reading_order(b, ["page"]).orderBy("position").collect()] == ["A", "B", "C"]
    assert [r.text for r in layout.reading_order_columns(b, ["page"], force=None).orderBy("position").collect()] == ["A", "C", "B"]
    assert col(spark, [120, 150, 300], layout.ocr_tolerance, "int") == [3, 4, 8]


def test_hyphens(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["adminis-", "tration act", "a-", "b-", "c"])], "doc_id int, line_no int, line string")
    assert [r.line for r in layout.merge_hyphens(df, ["doc_id"]).orderBy("line_no").collect()] == ["administration act", "ab-", "c"]


def test_tables(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [["1", ""]]), (None, [["1"]])], "h array<string>, r array<array<string>>")
    got = df.select(validate.table_issues(F.col("h"), F.col("r")).alias("i"), validate.fill_rate(F.col("h"), F.col("r")).alias("f")).collect()
    assert [r.i for r in got] == [["Row 1 has 2 cells, expected 3."], ["Table has no headers."]]
    assert [r.f for r in got] == [0.8, 1.0]
    assert col(spark, [[1.0, 5.0, 12.0, 13.0, 40.0]], tables.cluster, "array<double>") == [[1.0, 12.0, 40.0]]


def test_pdf(spark):
    pdf = b"%PDF-1.4\nstream\nBT (Hello World) Tj (a\\(b) Tj ET\nendstream"
    df = spark.createDataFrame([("a.pdf", bytearray(pdf)), ("b.pdf", bytearray(b"nope"))], "path string, content binary")
    got = df.select(literal_text(F.col("content")).alias("t"), upload_error(F.col("path"), F.length("content"), F.col("content")).alias("e")).collect()
    assert got[0].t == "Hello World\na(b" and got[0].e is None and got[1].e == "not a PDF"


def test_pdf_whole(spark, tmp_path):
    """Whole texts come back, with what has to be escaped, letters outside ISO-8859-1 and strings of any length."""
    from docengine import catalogue

    assert col(spark, [b"(C:\\\\new \\\\\\(a\\) \\n)"], literal_text, "binary") == ["C:\\new \\(a) \n"]
    texts = ["x" * 300 + " (a\\b) C:\\new\\run\r\n\\", "((" + "é ठરા… 𐍈)\\(" * 20000, "", None, "\\\\n)\n("]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.same for r in catalogue.pdf_literals(spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: True, 2: True, 3: None, 4: True}
    read = F.decode(F.encode(literal_text(literal_stream(F.col("text"))), "ISO-8859-1"), "UTF-8")
    assert [r.t for r in df.orderBy("doc_id").select(read.alias("t")).collect()] == texts


def test_http(spark):
    assert col(spark, ["unknown", "expired", "failed", "pending", "done"], jobs.http_status) == [404, 410, 500, 202, 200]


def test_results(spark, tmp_path):
    """Results are read until they expire, at their expiry no more."""
    rows = spark.createDataFrame([("a", "done", "x\ny", 0.9, "en", ["w"]), ("b", "failed", "", 0.0, "unknown", [])], "job_id string, status string, text string, confidence double, language string, warnings array<string>")
    for fmt in ("json", "parquet"):
        write_results(rows, str(tmp_path / fmt), F.lit("2024-01-01 00:00:00"), fmt=fmt)
        read = lambda at: {r.job_id: (r.text, r.warnings) for r in read_results(spark, str(tmp_path / fmt), F.lit(at), fmt).collect()}  # noqa: B023, E731
        assert read("2024-01-01 01:59:59") == {"a": ("x\ny", ["w"]), "b": ("", [])} and read("2024-01-01 02:00:00") == {}
