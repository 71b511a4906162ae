from docsieve.operators import ocr

WORDS = "document_id string, page_number int, word_idx int, text string, conf double, block_num int, par_num int, line_num int, page_num int, `left` int, top int, width int, height int"


def words(spark, rows):
    return spark.createDataFrame(rows, WORDS)


def sample(spark):
    return words(spark, [
        ("d", 1, 2, "world ", 80.0, 1, 1, 1, 1, 60, 12, 30, 10),
        ("d", 1, 0, "Hello", 90.0, 1, 1, 1, 1, 10, 10, 40, 10),
        ("d", 1, 1, "  ", 90.0, 1, 1, 1, 1, 0, 0, 900, 900),
        ("d", 1, 3, "ghost", -1.0, 1, 1, 1, 1, 0, 0, 900, 900),
        ("d", 1, 4, "faint", 20.0, 1, 1, 2, 1, 5, 30, 10, 10),
        ("d", 1, 5, "first", 100.0, 0, 9, 9, 9, 1, 1, 1, 1),
        ("d", 3, 0, "tail", 50.0, 1, 1, 1, 1, 1, 1, 1, 1),
        ("e", 1, 0, "", 50.0, 1, 1, 1, 1, 1, 1, 1, 1)])


def test_word_filter(spark, rows):
    kept = rows(ocr.ocr_word_filter(sample(spark), 0.5).orderBy("document_id", "page_number", "word_idx"))
    assert [(r["text"], r["confidence"]) for r in kept] == [("Hello", 0.9), ("world", 0.8), ("first", 1.0), ("tail", 0.5)]


def test_lines(spark, rows):
    line = [r for r in rows(ocr.ocr_lines(sample(spark))) if r["line_num"] == 1 and r["page_number"] == 1][0]
    assert (line["text"], line["bbox"], line["confidence"], line["word_count"]) == ("Hello world", [10, 10, 90, 22], 0.85, 2)


def test_page_and_document_text(spark, rows):
    pages = ocr.ocr_page_text(ocr.ocr_lines(sample(spark)))
    got = {(r["document_id"], r["page_number"]): r for r in rows(pages)}
    assert got["d", 1]["text"] == "first\nHello world\nfaint"
    assert [b["text"] for b in got["d", 1]["blocks"]] == ["first", "Hello world", "faint"]
    blank = spark.createDataFrame([("z", 1, "")], "document_id string, page_number int, text string")
    documents = ocr.ocr_document_text(pages.select("document_id", "page_number", "text").unionByName(blank))
    assert {r["document_id"]: r["ocr_text"] for r in rows(documents)} == {"d": "first\nHello world\nfaint\ntail", "z": None}
    nested = rows(ocr.ocr_documents(pages))
    assert [p["page_number"] for p in nested[0]["pages"]] == [1, 3]


def test_page_join_keeps_pages_without_ocr(spark, rows):
    pages = spark.createDataFrame([("d", 1), ("d", 2)], "document_id string, page_number int")
    joined = rows(ocr.page_ocr_join(pages, ocr.ocr_page_text(ocr.ocr_lines(sample(spark)))).orderBy("page_number"))
    assert joined[1]["ocr_text"] is None and joined[1]["ocr_blocks"] == []
    assert len(joined[0]["ocr_blocks"]) == 3 and len(joined) == 2


def test_page_select(spark, rows):
    documents = spark.createDataFrame([("d",), ("e",), ("f",)], "document_id string")
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1)], "document_id string, page_number int")
    assert ocr.page_select(pages).count() == 3
    assert rows(ocr.page_select(pages, 2)) == [{"document_id": "d", "page_number": 2}]
    errors = {r["document_id"]: r["error"] for r in rows(ocr.page_select_errors(documents, pages, 2))}
    assert errors == {"e": "Page 2 not found in document", "f": "Document has no pages to process"}
    assert rows(ocr.page_select_errors(documents, pages)) == [{"document_id": "f", "error": "Document has no pages to process"}]


def test_words_collapse_before_the_shuffle(spark):
    plan = ocr.ocr_lines(sample(spark))._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_list" in plan.split("Exchange")[1]
