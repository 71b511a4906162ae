"""Coordinate spaces, and words stored by document."""

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F
from test_ocr import WORDS, sample

from docsieve.operators import coordinates, ocr
from docsieve.sources import clustered

PAGES = "document_id string, page_number int, width int, height int, rotation double, scale_x double, scale_y double"


def forward(x, y, width, height, rotation, sx, sy):
    """Turn about the middle (counter-clockwise on the screen), then scale."""
    a, b, cx, cy = math.cos(math.radians(rotation)), math.sin(math.radians(rotation)), width / 2, height / 2
    return sx * (a * (x - cx) + b * (y - cy) + cx), sy * (-b * (x - cx) + a * (y - cy) + cy)


def test_a_point_goes_there_and_back(spark):
    rng = random.Random(4)
    pages = [("d", i, rng.randrange(500, 3000), rng.randrange(500, 3000), rng.choice([0.0, None, 90.0, -3.5, 12.25, 180.0]), rng.choice([1.0, 0.5, 0.37]), rng.choice([1.0, 0.25])) for i in range(40)]
    points = [(rng.uniform(0, 500), rng.uniform(0, 500)) for _ in pages]
    found = {r.page_number: r for r in coordinates.page_transforms(spark.createDataFrame(pages, PAGES)).collect()}
    for (_, page, w, h, rotation, sx, sy), (x, y) in zip(pages, points):
        u, v = forward(x, y, w, h, rotation or 0.0, sx, sy)
        m = found[page]
        assert math.isclose(m.a * u + m.b * v + m.c, x, abs_tol=1e-6) and math.isclose(m.d * u + m.e * v + m.f, y, abs_tol=1e-6)


def test_boxes_in_the_original(spark):
    pages = spark.createDataFrame([("d", 1, 100, 200, None, 0.5, 0.5), ("d", 3, 100, 200, 90.0, 1.0, 1.0), ("d", 3, 100, 200, 90.0, 1.0, 1.0), ("x", 1, None, 5, None, 1.0, 1.0),
                                   ("y", 1, 10, 10, None, 0.0, 1.0)], PAGES)
    transforms = coordinates.page_transforms(pages)
    assert transforms.count() == 2  # unknown sizes and a scale of zero give none, a repeated page one
    lines = ocr.ocr_lines(sample(spark))
    assert {r.coordinate_space for r in lines.collect()} == {"preprocessed"}
    moved = {(r.page_number, r.text): r for r in coordinates.to_space(lines, transforms).collect()}
    assert moved[1, "Hello world"].bbox == [20, 20, 180, 44] and moved[1, "Hello world"].coordinate_space == "original"
    assert moved[3, "tail"].bbox == [148, 51, 149, 52]  # x = cx + cy - y', y = x' + cy - cx
    again = coordinates.to_space(coordinates.to_space(lines, transforms), transforms)
    assert sorted(map(tuple, again.select("text", "bbox").collect())) == sorted((r.text, r.bbox) for r in moved.values())
    lost = coordinates.to_space(lines, transforms.filter("page_number = 1")).filter("page_number = 3").first()
    assert lost.bbox is None and lost.space_error == "no transform from preprocessed to original"


def test_spaces_never_mix(spark):
    words = sample(spark).withColumn("coordinate_space", F.when(F.col("word_idx") == 2, "original").otherwise("preprocessed"))
    lines = {r.text: r for r in ocr.ocr_lines(words).collect()}
    assert lines["Hello world"].bbox is None and lines["Hello world"].space_error == coordinates.MIXED_SPACES and lines["Hello world"].coordinate_space is None
    assert lines["tail"].coordinate_space == "preprocessed" and lines["tail"].space_error is None
    pages = ocr.ocr_page_text(ocr.ocr_lines(words))
    got = {r.page_number: r for r in pages.collect()}
    assert got[1].space_error == coordinates.MIXED_SPACES and got[1].text == "first\nHello world\nfaint" and got[3].coordinate_space == "preprocessed"
    nested = ocr.ocr_documents(pages).first().pages
    assert [p.coordinate_space for p in nested] == [None, "preprocessed"]
    joined = ocr.page_ocr_join(spark.createDataFrame([("d", 3)], "document_id string, page_number int"), pages).first()
    assert joined.coordinate_space == "preprocessed"
    # an error of a line is the page's too, as it was said
    lost = coordinates.to_space(ocr.ocr_lines(sample(spark)), coordinates.page_transforms(spark.createDataFrame([], PAGES)))
    assert {r.space_error for r in ocr.ocr_page_text(lost).collect()} == {"no transform from preprocessed to original"}


@pytest.fixture
def table(spark, tmp_path):
    name = "words_" + uuid.uuid4().hex
    rng = random.Random(1)
    rows = [(f"d{rng.randrange(30)}", rng.randrange(1, 4), i, rng.choice(["a", "b c", "", "ü"]), float(rng.randrange(-5, 100)), 1, 1, rng.randrange(5), 1, i, 1, 2, 3) for i in range(3000)]
    words = spark.createDataFrame(rows, WORDS)
    clustered.write_words(words, name, 6, str(tmp_path / "words"))
    yield name, words
    spark.sql(f"DROP TABLE {name}")


def test_three_levels_without_an_exchange(spark, table):
    name, words = table
    lines, pages, documents = clustered.clustered_text(spark, name)
    for level in (lines, pages, documents):
        assert "Exchange" not in level._jdf.queryExecution().executedPlan().toString()
    plain = ocr.ocr_lines(words)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(lines, plain) and same(pages, ocr.ocr_page_text(plain)) and same(documents, ocr.ocr_document_text(ocr.ocr_page_text(plain)))
