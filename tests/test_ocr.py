"""OCR tokens and passes, page scans, tables in results, and jobs, on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import classify, clean, jobs, layout, ocr, tables, validate
from docengine.plans import extraction
from docengine.sources import documents as D

TOKENS = "doc_id long, page int, ord int, box array<struct<x double, y double>>, text string, conf double"


def box(x, y, w=40.0, h=10.0):
    return [(x + w, y), (x, y), (x, y + h), (x + w, y + h)]


def lines(spark, tokens, dpi):
    t = ocr.placed(spark.createDataFrame(tokens, TOKENS))
    return [r.text for r in ocr.lines(t, ["doc_id", "page"], F.lit(dpi)).orderBy("line").collect()]


def test_lines(spark):
    two = [(1, 1, 0, box(10.0, 200.0), "Second", 0.9), (1, 1, 1, box(10.0, 100.0), "First", 0.9)]
    assert lines(spark, two, 150) == ["First", "Second"]
    close = [(1, 1, 0, box(200.0, 100.0), "Upper", 0.9), (1, 1, 1, box(10.0, 106.0), "Lower", 0.9)]
    assert lines(spark, close, 120) == ["Upper", "Lower"] and lines(spark, close, 300) == ["Lower Upper"]
    # the row's leftmost token anchors its line, so the next row's may still fall into it
    fused = [(1, 1, 0, box(10.0, 104.0), "b", 0.9), (1, 1, 1, box(50.0, 100.0), "c", 0.9), (1, 1, 2, box(10.0, 107.5), "d", 0.9)]
    assert lines(spark, fused, 150) == ["b c d"]


def test_page_results(spark):
    rows = [(1, 1, 0, box(10.0, 10.0), "adminis-", 0.8), (1, 1, 1, box(10.0, 40.0), "tration act", 0.4), (1, 1, 2, box(90.0, 40.0), "noise", 0.29), (1, 1, 3, None, "x", 0.9), (1, 1, 4, box(0.0, 0.0), None, 0.9), (1, 2, 0, box(0.0, 0.0), "faint", 0.1)]
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc_id long, page int")
    got = {(r.doc_id, r.page): (r.text, round(r.confidence, 6)) for r in ocr.page_results(spark.createDataFrame(rows, TOKENS), pages, ["doc_id", "page"], F.lit(150)).collect()}
    assert got == {(1, 1): ("administration act", 0.6), (1, 2): ("", 0.0), (2, 1): ("", 0.0)}
    df = spark.createDataFrame([([95.0, -1.0, 0.5, 1.0],), ([],), ([-1.0],)], "c array<double>")
    assert [round(r.m, 6) for r in df.select(ocr.mean_confidence(F.col("c")).alias("m")).collect()] == [round((0.95 + 0.5 + 1.0) / 3, 6), 0.0, 0.0]


def test_passes(spark):
    p = spark.createDataFrame([(1, 0, "same", 0.5), (1, 1, "emas", 0.5), (2, 0, "", 0.9), (2, 1, "text", 0.1)], "doc_id long, ord int, text string, conf double")
    assert {r.doc_id: r.ord for r in ocr.best_pass(p, ["doc_id"]).collect()} == {1: 0, 2: 1}
    schema = "page int, primary struct<text:string,conf:double>, retry struct<text:string,conf:double>, english struct<text:string,conf:double>"
    rows = [(1, ("good text", 0.9), ("better text", 1.0), None), (2, (" ", 0.9), ("retry", 0.5), ("eng", 1.0)), (3, ("", 0.0), ("", 0.0), ("eng", 0.2)), (4, ("%%%%", 0.2), None, None), (5, ("", 0.0), None, None)]
    got = {r.page: (r.text, r.segmentation, r.warnings) for r in ocr.ladder(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == ("good text", 6, []) and got[2] == ("retry", 11, []) and got[3][:2] == ("eng", 6)
    assert got[4] == ("", 6, ["Page 4: Tesseract returned no usable text."]) and got[5][0] == ""
    assert ocr.ladder(spark.createDataFrame(rows[2:3], schema), "eng").first().text == ""
    assert [ocr.language_pack(x) for x in (["eng", "guj", "hin"], ["guj"], ["eng"], [])] == ["guj+eng", "guj", "eng", "guj+eng"]
    two = "id int, fast struct<text:string,confidence:double>, heavy struct<text:string,confidence:double>"
    rows = [(1, ("long enough text", 0.9), None), (2, ("x", 0.9), ("y", 0.1)), (3, ("long enough text", 0.5), ("long enough text", 0.5)), (4, ("long enough text", 0.3), ("long enough text", 0.9)), (5, None, None)]
    assert {r.id: r.path for r in ocr.fast_or_heavy(spark.createDataFrame(rows, two)).collect()} == {1: "fast", 2: "heavy", 3: "fast", 4: "heavy", 5: "none"}


def test_zip_images(spark):
    n = spark.createDataFrame([(1, 5), (1, 2), (1, 9)], "doc_id long, page int")
    i = spark.createDataFrame([(1, 0, b"a"), (1, 1, b"b")], "doc_id long, ord int, image binary")
    assert {r.page: bytes(r.image) for r in ocr.zip_images(n, i, ["doc_id"]).collect()} == {2: b"a", 5: b"b"}


def test_nfkc_everywhere(spark):
    text = "ﬁrst line ﬃ\nＡＢＣ wide\ncafé stays\né composed"
    want = "first line ffi\nABC wide\ncafé stays\né composed"
    df = spark.createDataFrame([(1, 1, text, 0.9, "digital")], "doc_id long, page int, text string, confidence double, pdf_type string")
    assert clean.clean_text(df, "doc_id").first().text == want == clean.clean_pages(df).first().text
    assert [r.line for r in clean.to_lines(df, "doc_id").collect()] == want.split("\n")
    assert want.split("\n")[0] in extraction.extract(df).first().text


def test_clean_pages_keeps_rows(spark):
    long = "this is quite a long line of text that repeats itself number"
    rows = [(1, 1, f"Head\n{long} 1\n{long} 2\n----------\nbody", "k"), (1, 2, "Head\nother", "k"), (1, 3, "###---###", "k"), (2, 1, "Head", "k"), (3, 1, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, page int, text string, keep string")
    got = {(r.doc_id, r.page): r.text for r in clean.clean_pages(df).collect()}
    assert got == {(1, 1): f"{long} 1\nbody", (1, 2): "other", (1, 3): "", (2, 1): "Head", (3, 1): ""}
    exact = {(r.doc_id, r.page): r.text for r in clean.clean_pages(df, near=False).collect()}
    assert exact[1, 1] == f"{long} 1\n{long} 2\nbody"


def test_hyphens_in_rows(spark):
    cases = [["adminis-", "tration act", "next line"], ["a-", "b-", "c"], ["a-", "b-"], ["-"], [], ["x-", "  y", "z-"], ["-", "-", "-", "-"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, lines array<string>")
    got = {r.i: r.lines for r in layout.merge_hyphens_in(df, "lines").collect()}
    for i, x in enumerate(cases):
        out, j = [], 0
        while j < len(x):
            if x[j].endswith("-") and j + 1 < len(x):
                out.append(x[j][:-1] + x[j + 1].lstrip())
                j += 2
            else:
                out.append(x[j])
                j += 1
        assert got[i] == out


@pytest.mark.parametrize(
    ("args", "want"),
    [(("gu", "hybrid"), "gujarati"), (("hindi", "hybrid", ["gu"]), "gujarati"), (("en", "hybrid", ["tamil"]), "english"), (("gu", " Paddle"), "english"), (("en", "TESSERACT"), "gujarati"), ((None, None), "english"), (("en", "hybrid", ["Guj "]), "gujarati")],
)
def test_pipeline_language(args, want):
    assert classify.resolve_ocr_language(*args) == want


def test_engine_language():
    f = classify.resolve_engine_language
    assert [f("guj", "paddle"), f(None, "paddle", "gu"), f(None, "Tesseract"), f(None, "hybrid", "gu"), f("hindi", None, "hindi"), f("en", "tesseract", "gu")] == ["gujarati", "english", "gujarati", "gujarati", "english", "english"]


def test_single_page_rule(spark):
    schema = "doc_id long, page int, text string, block_text string, word_text string, rescue_text string, has_images boolean, coverage double"
    rows = [(1, 1, "", "", "", "rescued text of a page", True, 0.0), (2, 1, "", "", "", "", False, None), (3, 1, "", "", "", "", True, 0.0), (4, 1, "", "", "", "rescued", False, 0.0), (4, 2, "ગુજરાતી", "", "", "", True, 0.003), (5, 1, "x" * 30, "", "", "", True, 0.006)]
    got = {(r.doc_id, r.page): (r.pdf_type, r.char_count) for r in classify.classify_pages(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 1): ("digital", 22), (2, 1): ("digital", 0), (3, 1): ("scanned", 0), (4, 1): ("scanned", 7), (4, 2): ("digital", 7), (5, 1): ("digital", 30)}


def test_extract_with_tables(spark):
    schema = "doc_id long, page int, text string, confidence double, pdf_type string, warnings array<string>"
    rows = [(1, 3, "adminis", 0.9, "digital", ["own"]), (1, 7, "tration act of many words that goes on and on.", 0.5, "scanned", []), (2, 1, "", None, "scanned", None)]
    raw = [(1, 3, 0, [["H1", None], ["a", "b"]], 0.5), (1, 3, 1, [["only"]], 0.5), (2, 1, 0, [["x", "y"], ["z", "w"]], 0.5)]
    pages = spark.createDataFrame(rows, schema)
    cells = spark.createDataFrame(raw, "doc_id long, page int, table_index int, cells array<array<string>>, accuracy double")
    found = tables.digital_tables(cells.join(tables.table_pages(pages), ["doc_id", "page"], "left_semi"))
    got = {r.doc_id: r for r in extraction.extract(pages, tables=found, ocr_language="gujarati").collect()}
    one = got[1]
    assert [(t.page, t.headers, t.rows, t.extraction_method) for t in one.tables] == [(3, ["H1", ""], [["a", "b"]], "unknown")] and not got[2].tables
    assert one.pages[0].warnings == ["own", "Page boundary stitch: merged with page 2"] and one.pages[0].text.startswith("adminis tration act")
    assert one.pages[1].warnings == ["No text extracted from this page.", "Low OCR confidence (0.50). Review recommended."]
    assert "Page 3: Page boundary stitch: merged with page 2" in one.metadata.warnings and one.metadata.total_warning_count == 4
    assert (one.language, one.metadata.ocr_engine, one.metadata.overall_type) == ("gujarati", "Tesseract", "mixed") and one.text == one.full_text
    assert [t.headers for t in extraction.tables_view(spark.createDataFrame([one], extraction.extract(pages, tables=found).schema)).collect()] == [["H1", ""]]
    bad = spark.createDataFrame([(1, 3, 0, None, [["a"]]), (1, 3, 1, ["a"], [["b"]])], "doc_id long, page int, table_index int, headers array<string>, rows array<array<string>>")
    report = {r.doc_id: r for r in validate.report(pages.drop("warnings"), bad).collect()}
    assert [(i.page, i.table_index, i.issues) for i in report[1].table_issues] == [(3, 0, ["Table has no headers."])] and report[2].table_issues == [] and report[1].stitched == 1
    assert tables.document_tables(tables.page_tables(pages, cells)).where("doc_id = 1").first().tables[0].headers == ["H1", ""]


def test_valid_confidence(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.01,), (-0.1,), (None,), (math.nan,)], "c double")
    assert [r.v for r in df.select(validate.valid_confidence(F.col("c")).alias("v")).collect()] == [True, True, False, False, False, False]


def test_scans(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", "boom"), (2, 1, "c", None)], "doc_id long, page int, text string, error string")
    wanted = spark.createDataFrame([(1, 2), (1, 99), (1, 0)], "doc_id long, page int")
    got = {(r.doc_id, r.page): (r.text, r.warnings) for r in D.selected_pages(pages, wanted).collect()}
    assert got == {(1, 2): ("", ["Extraction failed: boom"]), (2, 1): ("c", [])}
    assert D.selected_pages(pages).count() == 3
    parts = spark.createDataFrame([(1, 1, 1, " two "), (1, 1, 0, "one"), (1, 1, 2, " ")], "doc_id long, page int, ord int, text string")
    blank = spark.createDataFrame([(1, 1, " "), (1, 2, None), (1, 3, " t ")], "doc_id long, page int, text string")
    none = parts.where("false")
    assert {r.page: r.text for r in D.fallback_map(blank, parts, none).collect()} == {1: "one\ntwo", 2: "", 3: "t"}
    assert {r.page: r.text for r in D.fallback_map(blank, none, parts).collect()} == {1: "one two", 2: "", 3: "t"}
    text = D.fallback_map(blank, parts, none)
    assert D.fallback_document(text).first().text == "one\ntwo\n\n---\n\nt"
    assert [D.fallback_document(text, p).first().text for p in (3, 9)] == ["t", ""]
    blocks = spark.createDataFrame([(" ab ", 1.0, 1.2), (" abc ", 1.0, 9.0), ("  ", 0.0, 1.0)], "text string, y0 double, y1 double")
    assert [r.text for r in D.solid_blocks(blocks).collect()] == ["abc"] and [(r.text, r.height) for r in D.solid_words(blocks).collect()] == [("ab", 1.0), ("abc", 8.0)]
    (tmp_path / "here.pdf").write_bytes(b"%PDF-")
    gone = f"file://{tmp_path}/gone.pdf"
    assert [r.path for r in D.missing_files(spark, [f"file://{tmp_path}/here.pdf", gone]).collect()] == [gone]


def test_uploads(spark):
    pdf = b"%PDF-1.4 x"
    rows = [("application/pdf", "a.pdf", pdf, 200), ("text/plain", "a.pdf", pdf, 415), ("application/octet-stream", "a.txt", pdf, 400), ("application/octet-stream", "A.PDF", pdf, 200), ("application/x-pdf", "a.pdf", b"nope", 400), ("application/pdf", "a.pdf", b"", 400), ("application/pdf", "a.pdf", pdf * 50, 413), (None, "a.pdf", pdf, 415)]
    df = spark.createDataFrame([(m, p, bytearray(c), w) for m, p, c, w in rows], "m string, p string, c binary, w int")
    got = df.select("w", D.upload_status(F.col("m"), F.col("p"), F.length("c"), F.col("c"), 100).alias("s")).collect()
    assert [r.s for r in got] == [r.w for r in got]
    odd = spark.createDataFrame([(b"%PDF /Type /Pages /Count 0 >>",), (b"%PDF /Encrypt 5 0 R",), (b"%PDF /Count 10",)], "c binary")
    assert [r.e for r in odd.select(D.upload_error(F.lit("x.pdf"), F.length("c"), F.col("c")).alias("e")).collect()] == ["zero pages", "encrypted", None]


def test_results_replace(spark, tmp_path):
    schema = "job_id string, status string, text string, confidence double, language string, warnings array<string>"
    row = lambda j, t: spark.createDataFrame([(j, "done", t, 0.9, "en", [])], schema)
    path, day = str(tmp_path / "r"), "2024-01-01 "
    D.write_results(row("a", "old"), path, F.lit(day + "00:00:00"))
    D.write_results(row("a", "new"), path, F.lit(day + "00:10:00"))
    D.write_results(row("b", "kept"), path, F.lit(day + "00:00:00"), None)
    D.write_results(row("c", "gone"), path, F.lit(day + "00:00:00"))
    D.delete_results(spark.createDataFrame([("c",), ("never",)], "job_id string"), path, F.lit(day + "00:05:00"))
    read = lambda at: {r.job_id: r.text for r in D.read_results(spark, path, F.lit(day + at)).collect()}
    assert read("00:20:00") == {"a": "new", "b": "kept"}
    assert read("02:00:00") == {"a": "new", "b": "kept"} and read("02:00:01") == {"a": "new"} and read("02:10:00") == {}
    D.compact(spark, path, str(tmp_path / "s"), F.lit(day + "00:20:00"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    failed = D.failed_report(spark.createDataFrame([("x",)], "job_id string"), F.lit("why")).first()
    assert (failed.status, failed.error, failed.metadata.pdf_type, failed.metadata.total_warning_count) == ("failed", "why", "unknown", 0)
    D.write_results(D.failed(spark.createDataFrame([("z",)], "job_id string"), F.lit("why")), path, F.lit(day + "00:00:00"), None)
    assert D.current_results(spark, path).where("job_id = 'z'").first().expires_at is None


def test_jobs(spark):
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    uploads = spark.createDataFrame([(5, "x"), (6, "y"), (7, "z")], "job_id long, sha256 string")
    results = spark.createDataFrame([(1, "x", "done", 3600), (2, "y", "done", -5), (3, "y", "failed", 3600)], "job_id long, sha256 string, status string, s int")
    results = results.withColumn("expires_at", at + F.make_interval(secs=F.col("s"))).drop("s")
    got = {r.job_id: (r.action, r.cached_job, r.delete_job) for r in jobs.reuse(uploads, results, at).collect()}
    assert got == {5: ("reuse", 1, 5), 6: ("process", None, 2), 7: ("process", None, None)}
    assert jobs.reuse(uploads, results, at, reuse_failed=True).where("job_id = 6").first().cached_job == 3
    e = spark.createDataFrame([("OSError", 0), ("MemoryError", 1), ("OSError", 2), ("ValueError", 0), ("KeyError", 0)], "e string, n int")
    assert [r.a for r in e.select(jobs.after_error(F.col("e"), F.col("n")).alias("a")).collect()] == ["retry", "retry", "fail", "fail", "fail"]
    assert [jobs.soft_limit(x) for x in (300, 40)] == [270, 30]
    states = spark.createDataFrame([(1, "processing")], "job_id long, state string")
    asked = spark.createDataFrame([(1,), (9,), (9,)], "job_id long")
    assert {r.job_id: (r.status, r.was) for r in jobs.cancel(states, asked).collect()} == {1: ("cancelled", "processing"), 9: ("cancelled", None)}
    s = spark.createDataFrame([(x,) for x in ("unknown", "expired", "failed", "done", "pending")], "s string")
    view = lambda v: [r.x for r in s.select(jobs.view_status(F.col("s"), v).alias("x")).collect()]
    assert (view("full"), view("text"), view("status")) == ([404, 410, 500, 200, 202], [404, 410, 202, 200, 202], [404, 200, 200, 200, 200])


def test_ocr_score_gujarati(spark):
    df = spark.createDataFrame([("ગુજ", 0.2), ("abc", 0.2), ("", 0.9)], "t string, c double")
    assert [r.s for r in df.select(T.ocr_score(F.col("t"), F.col("c")).alias("s")).collect()] == [0.6, 0.45, 0.0]


def test_settings(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00+02:00", 1, 3), ("2024-01-01T00:00:00", 3, 3), ("2024-01-01T00:00:00.5Z", 0, 7), ("soon", 1, 8)], "t string, a int, b int")
    got = df.select(F.unix_millis(jobs.parse_expiry(F.col("t"))).alias("t"), jobs.progress(F.col("a"), F.col("b"), F.lit("ocr")).alias("p")).collect()
    assert [r.t for r in got] == [1704060000000, 1704067200000, 1704067200500, None]
    assert [r.p.progress for r in got] == [33.3, 100.0, 0.0, 12.5] and got[0].p.message == "Processing ocr chunk 1/3"
    tiers = df.select(*[classify.render_dpi(F.lit(d), x).alias(f"{x}{d}") for x in ("gujarati", "english") for d in (100, 350)]).first()
    assert tuple(tiers) == (150, 350, 300, 350)


def test_files_and_decoders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in (("a.pdf", b"%PDF-1.4 one"), ("sub/b.pdf", b"nope"), ("c.txt", b"%PDF")):
        (tmp_path / name).write_bytes(content)
    files = D.raw_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.error, len(r.sha256)) for r in files.collect()}
    assert got == {"a.pdf": (12, None, 64), "b.pdf": (4, "not a PDF", 64)}

    def decoder(content):
        if content == b"nope":
            raise ValueError("broken")
        return [(1, content.decode(), [], None), (2, "", ["w"], None)]

    pages = {(r.path.rsplit("/", 1)[1], r.page): (r.text, r.error) for r in D.decode(files, decoder).collect()}
    assert pages == {("a.pdf", 1): ("%PDF-1.4 one", None), ("a.pdf", 2): ("", None), ("b.pdf", None): ("", "ValueError: broken")}
    images = spark.createDataFrame([(1, 1, bytearray(b"ab")), (1, 2, bytearray(b""))], "doc_id long, page int, image binary")
    read = D.image_pages(images, lambda b: (b.decode().upper(), len(b) / 2)).orderBy("page").collect()
    assert [(r.doc_id, r.page, r.text, r.confidence) for r in read] == [(1, 1, "AB", 1.0), (1, 2, "", 0.0)]


def test_views(spark):
    df = spark.createDataFrame([(1, 1, "One sentence of a page.", 0.9, "digital")], "doc_id long, page int, text string, confidence double, pdf_type string")
    r = extraction.extract(df)
    assert extraction.status_view(r).first().asDict() == {"doc_id": 1, "status": "done", "confidence": 0.9}
    assert extraction.text_view(r).first().text == "[Page 1]\nOne sentence of a page."
    states = spark.createDataFrame([(x,) for x in ("PENDING", "SUCCESS", "FAILURE", "Processing")], "s string")
    assert [r.w for r in states.select(jobs.worker_state(F.col("s")).alias("w")).collect()] == ["pending", "done", "failed", "processing"]
    old = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 01:00:00")], "job_id long, m string").select("job_id", F.to_timestamp("m").alias("modified"))
    assert jobs.purged(old, F.to_timestamp(F.lit("2024-01-01 01:00:01"))).first().n == 1
