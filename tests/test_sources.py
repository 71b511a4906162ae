import json

import pytest
from pyspark.sql import functions as F

from docsieve.operators import ocr
from docsieve.sources import files, manifest

PDF, PNG, JPG = b"%PDF-1.7 x", b"\x89PNG\r\n\x1a\n...", b"\xff\xd8\xff\xe0..."


def test_manifest_of_real_files(spark, rows, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in [("a.pdf", PDF), ("b.PNG", PNG), ("sub/c.jpeg", JPG), ("d.jpg", b"not an image"), ("e.txt", b"x"), ("noext", b"x"), ("f.pdf", b"zip")]:
        (tmp_path / name).write_bytes(content)
    scan = manifest.manifest_scan(spark, str(tmp_path))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "document_files" in plan and "content" not in plan
    got = {r["filename"]: r for r in rows(manifest.manifest_validate(manifest.manifest_scan(spark, str(tmp_path), signatures=True)))}
    assert {n: (r["file_type"], r["reason"]) for n, r in got.items()} == {
        "a.pdf": ("pdf", None), "b.PNG": ("png", None), "c.jpeg": ("jpeg", None), "d.jpg": ("jpg", "corrupt_content"),
        "e.txt": (None, "unsupported_type"), "noext": (None, "unsupported_type"), "f.pdf": ("pdf", "corrupt_content")}
    assert got["b.PNG"]["page_count"] == 1 and got["a.pdf"]["page_count"] is None and got["a.pdf"]["file_size_bytes"] == len(PDF)
    dotted = spark.createDataFrame([("/x/.pdf", 1, 1)], "source_path string, file_size_bytes long, page_count int")
    assert manifest.manifest_validate(dotted).first().reason == "unsupported_type"
    checked = manifest.signature_check(manifest.manifest_scan(spark, str(tmp_path), signatures=True))
    assert checked.filter("signature_ok").count() == 3


def test_requested_paths(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(PNG)
    scan = manifest.manifest_scan(spark, str(tmp_path))
    root = scan.first().source_path.rsplit("/", 2)[0]
    asked = spark.createDataFrame([(f"{root}/in/a.png",), (f"{root}/in/",), (f"{root}/gone.png",)], "source_path string")
    got = {r["source_path"].rsplit("/", 1)[1]: r["reason"] for r in rows(manifest.manifest_validate(manifest.manifest_requests(asked, scan)))}
    assert got == {"a.png": None, "in": "not_a_file", "gone.png": "not_found"}


def test_pages(spark, rows):
    listed = spark.createDataFrame([("/a.pdf", 1, 3), ("/b.png", 1, 9), ("/c.pdf", 1, 0), ("/d.doc", 1, 2)], "source_path string, file_size_bytes long, page_count int")
    checked = manifest.manifest_validate(listed)
    assert rows(manifest.quarantine(checked).select("source_path", "reason").orderBy("source_path")) == [
        {"source_path": "/c.pdf", "reason": "corrupt_content"}, {"source_path": "/d.doc", "reason": "unsupported_type"}]
    pages = manifest.page_explode(checked)
    assert sorted((r["source_path"], r["page_number"]) for r in rows(pages)) == [("/a.pdf", 1), ("/a.pdf", 2), ("/a.pdf", 3), ("/b.png", 1)]


def test_truth_source(spark, rows, tmp_path):
    documents = [
        {"document_id": "d1", "image_path": "x.png", "document_type": "invoice", "fields": {"amount": "5", "date": None},
         "table": {"columns": ["a"], "rows": [["1"], [None]]}, "question": "q", "answer": "5"},
        {"document_id": "d2", "document_type": "identity_document"}]
    (tmp_path / "truth.json").write_text(json.dumps({"documents": documents}, indent=1))
    got = {r["document_id"]: r for r in rows(files.truth_source(spark, str(tmp_path)))}
    assert got["d1"]["expected_fields"] == {"amount": "5", "date": None} and got["d1"]["expected_rows"] == [["1"], [None]]
    assert got["d2"]["expected_fields"] == {} and got["d2"]["expected_rows"] == []


def test_truth_in_splittable_forms(spark, rows, tmp_path):
    document = {"document_id": "d1", "document_type": "invoice", "fields": {"amount": "5"}, "table": {"columns": ["a"], "rows": [["1"]]}}
    (tmp_path / "truth.jsonl").write_text("\n".join(json.dumps({**document, "document_id": f"d{i}"}) for i in range(3)))
    lines = files.truth_source(spark, str(tmp_path / "truth.jsonl"), "jsonl")
    spark.read.schema(files.TRUTH_DOCUMENT).json(str(tmp_path / "truth.jsonl")).write.parquet(str(tmp_path / "parquet"))
    for got in (lines, files.truth_source(spark, str(tmp_path / "parquet"), "parquet")):
        assert sorted(r["document_id"] for r in rows(got)) == ["d0", "d1", "d2"]
        assert all(r["expected_fields"] == {"amount": "5"} and r["expected_rows"] == [["1"]] for r in rows(got))


def test_ocr_side_files(spark, rows, tmp_path):
    texts = tmp_path / "texts"
    for folder in ("a", "b", "c d+e"):
        (texts / folder).mkdir(parents=True)
        (texts / folder / "page_1.txt").write_text(f"text of {folder}\nline two\n")
    (texts / "b" / "page_1.ocr").write_text("another")
    (texts / "scan.v1.txt").write_text("top")
    documents = spark.createDataFrame(
        [(f"file:/in/x/{name}",) for name in ("a/page_1.png", "b/page_1.png", "c d+e/page_1.png", "scan.v1.png", "other.png", "page_1.png")], "source_path string")
    joined = files.with_ocr_text(documents, files.ocr_text_source(spark, str(texts)), "/in/x")
    got = {r["source_path"].removeprefix("file:/in/x/"): (r["ocr_text"], r["ocr_error"]) for r in rows(joined)}
    assert joined.count() == 6
    assert got == {"a/page_1.png": ("text of a\nline two\n", None), "b/page_1.png": (None, "side files with one name: 2"),
                   "c d+e/page_1.png": ("text of c d+e\nline two\n", None), "scan.v1.png": ("top", None), "other.png": (None, None), "page_1.png": (None, None)}


def test_sinks(spark, rows, tmp_path):
    files.write_report(spark.range(1).select(F.lit(None).cast("double").alias("score")), str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ['{"score":null}']
    pages = spark.createDataFrame([("d", 1, "t\nu", [("t", [0, 0, 1, 1], 0.5)])], f"document_id string, page_number int, text string, blocks array<{ocr.BLOCK}>")
    files.write_ocr_json(ocr.ocr_documents(pages), str(tmp_path / "ocr"))
    assert json.loads(spark.read.text(str(tmp_path / "ocr")).first().value) == {
        "document_id": "d", "pages": [{"page_number": 1, "text": "t\nu", "blocks": [{"text": "t", "bbox": [0, 0, 1, 1], "confidence": 0.5}]}]}


RUNS = "document_id string, status string, task string"


def test_runs_can_be_written_again(spark, tmp_path):
    path = str(tmp_path / "runs")
    write = lambda run_id, *records: files.write_runs(spark.createDataFrame(records, RUNS), path, run_id)
    read = lambda: sorted((r.run_id, r.task, r.document_id, r.status) for r in files.read_runs(spark, path, RUNS).collect())
    write("a", ("d1", "RUN", "classification"), ("d2", "RUN", "classification"), ("d1", "RUN", "summarization"))
    write("b", ("d1", "FAILED", "classification"))
    write("a", ("d3", "RUN", "classification"))
    expected = [("a", "classification", "d3", "RUN"), ("a", "summarization", "d1", "RUN"), ("b", "classification", "d1", "FAILED")]
    assert read() == expected
    assert (tmp_path / "runs" / "records" / "run_id=a" / "task=classification").is_dir()
    # a write that fails before its end changes nothing
    bad = spark.createDataFrame([("d9", "RUN", "classification")], RUNS).withColumn("status", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception):
        files.write_runs(bad, path, "a")
    assert read() == expected
    # one that ends between records and commit record is seen, and left out
    torn = spark.createDataFrame([("d7", "RUN", "a", "summarization", "other write")], "document_id string, status string, run_id string, task string, write_id string")
    torn.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "task").parquet(path + "/records")
    assert read() == [r for r in expected if r[1] != "summarization"]
    assert {(r.run_id, r.task): r.whole for r in files.run_commits(spark, path).filter("not whole").collect()} == {("a", "summarization"): False}


def test_a_write_of_runs_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    """Each write left its shuffle files beside those of the next."""
    seen, key = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    monkeypatch.setattr(files, "_found", lambda *a, found=files._found: seen.append(spark.conf.get(key)) or found(*a))
    runs = spark.createDataFrame([("d1", "summarization", "RUN")], "document_id string, task string, status string")
    during = []
    probe = runs.mapInArrow(lambda batches: batches, runs.schema)
    monkeypatch.setattr(files, "settings", lambda s, values, held=files.settings: during.append(values) or held(s, values))
    files.write_runs(probe, str(tmp_path / "runs"), "one")
    assert during == [{key: "true"}] and seen == [spark.conf.get(key)]
    assert [(r.document_id, r.status) for r in files.read_runs(spark, str(tmp_path / "runs"), RUNS).collect()] == [("d1", "RUN")]
