"""The file listing as a data source, and JSON files that many tasks read."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.sources import files, jsonsplit, manifest, remote

PNG = b"\x89PNG\r\n\x1a\n..."


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- listing -----------------------------------------------------------------------------


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    for folder in ("", "a", "a/b", "_hidden", ".dot", "c/d/e"):
        (root / folder).mkdir(parents=True, exist_ok=True)
        for i in range(3):
            (root / folder / f"{'_.'[i % 2] if i else ''}file{i}.{'png' if i < 2 else 'pdf'}").write_bytes(PNG * (i + 1))
    return root


@pytest.mark.parametrize("options", [{}, {"folders": 1}, {"folders": 2, "files": 2}, {"bytes": 20}])
def test_all_names_are_listed_whatever_the_partitions(spark, tree, options):
    scan = manifest.manifest_scan(spark, str(tree), **options)
    got = sorted((r.source_path, r.file_size_bytes) for r in scan.collect())
    expected = sorted(("file:" + os.path.join(folder, name), os.path.getsize(os.path.join(folder, name))) for folder, _, names in os.walk(tree) for name in names)
    assert got == expected and len(got) == 18
    assert {r.modified_at.year for r in scan.collect()} >= {2020} or scan.first().modified_at is not None


def test_partitions_hold_bounded_numbers_of_files(spark, tree):
    assert manifest.manifest_scan(spark, str(tree), files=4).rdd.getNumPartitions() == 5
    assert manifest.manifest_scan(spark, str(tree), folders=1).rdd.getNumPartitions() == 1 + 4  # root's files, and a partition a folder left
    assert manifest.manifest_scan(spark, str(tree / "a")).count() == 6
    assert manifest.manifest_scan(spark, str(tree / "nothing here")).count() == 0
    assert manifest.manifest_scan(spark, str(tree / "file0.png")).count() == 1


def test_filters_reach_the_listing(spark, tree):
    scan = manifest.manifest_scan(spark, str(tree), signatures=True).filter(F.col("source_path").endswith(".png") & (F.col("file_size_bytes") > 11))
    assert "Filter" not in plan_of(scan.select("source_path", "file_size_bytes")) or "endswith" not in plan_of(scan).lower()
    assert scan.count() == 6
    assert manifest.manifest_scan(spark, str(tree)).filter("file_size_bytes between 12 and 22").count() == 6
    assert manifest.manifest_scan(spark, str(tree)).filter("length(source_path) > 5 and file_size_bytes = 11").count() == 6


def test_a_huge_file_costs_eight_bytes(spark, tmp_path, monkeypatch):
    huge = tmp_path / "huge.png"
    with huge.open("wb") as file:
        file.write(PNG)
        file.truncate(1 << 30)  # sparse
    read = []
    real = remote.opened("file:/x")[0]

    class Counting:
        def open_input_file(self, path):
            file = real.open_input_file(path)

            class Counted:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    file.close()

                def seek(self, at):
                    file.seek(at)

                def read(self, n):
                    read.append(n)
                    return file.read(n)
            return Counted()
    monkeypatch.setattr(remote, "opened", lambda uri: (Counting(), uri.removeprefix("file:")))
    assert remote.read_range(str(huge), 0, 8) == PNG[:8] and read == [8]
    monkeypatch.undo()
    scan = manifest.manifest_scan(spark, str(tmp_path), signatures=True)
    assert "content" not in plan_of(scan)
    row = manifest.signature_check(scan).first()
    assert row.signature_ok and row.file_size_bytes == 1 << 30 and row.head == PNG[:8].hex().upper()


# ---- JSON that splits ------------------------------------------------------------------------


def structure_plainly(text, in_string, escaped):
    at, step = [], []
    for i, c in enumerate(text):
        if escaped and (in_string or chr(c) not in "{[}]"):
            escaped = 0
        elif c == ord("\\"):
            escaped = 1
        elif c == ord('"'):
            in_string = 1 - in_string
        elif not in_string and chr(c) in "{[}]":
            escaped = 0  # a backslash outside a string is no JSON; brackets stay brackets
            at.append(i)
            step.append(1 if chr(c) in "{[" else -1)
    return at, step, in_string, escaped


def test_structure_equals_a_scan_of_single_bytes():
    rng = random.Random(2)
    for _ in range(400):
        text = bytes(rng.choice(b'{}[]"\\\\\\ax:,') for _ in range(rng.randrange(0, 40)))
        for state in ((0, 0), (1, 0), (1, 1)):
            at, step, ends_in, ends_escaped = jsonsplit.structure(np.frombuffer(text, np.uint8), *state)
            assert (at.tolist(), step.tolist(), ends_in, ends_escaped) == structure_plainly(text, *state), (text, state)


def truth_document(rng, i):
    nasty = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", "documents", "é", "\n", " ", ":", "\U0001f600", "x" * 30]) for _ in range(rng.randrange(6)))
    return {"document_id": f"d{i}", "image_path": nasty(), "document_type": rng.choice(["invoice", None]), "fields": {nasty() + str(k): rng.choice([nasty(), None, 5, True]) for k in range(rng.randrange(4))},
            "table": {"columns": ["a", "documents"], "rows": [[nasty(), None]] * rng.randrange(3)}, "question": nasty(), "answer": None}


@pytest.mark.parametrize("range_bytes", [7, 64, 1000, 1 << 20])
def test_splitting_reader_equals_the_one_record_reader(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    documents = [truth_document(rng, i) for i in range(12 if range_bytes < 64 else 40)]
    other = {"documents": [{"document_id": "inner"}], "x": [[{"document_id": "deep"}]]}
    roots = [{"documents": documents[:5]}, {"meta": other, "list": [{"document_id": "no"}], 'a"documents': [{"document_id": "no"}], "documents": documents[5:], "after": [{"document_id": "no"}]},
             {"documents": []}, {"note": "documents"}, {"documents": None}]
    folder = tmp_path / "truth"
    folder.mkdir()
    for i, root in enumerate(roots):
        (folder / f"t{i}.json").write_text(json.dumps(root, indent=[None, 1, 4][i % 3], ensure_ascii=bool(i % 2)), encoding="utf-8")
    (folder / "_SUCCESS").write_text("")
    columns = ["document_id", "image_path", "document_type", "expected_rows", "question", "answer"]
    read = lambda form: sorted(
        ([r[c] for c in columns] + [sorted(r.expected_fields.items(), key=repr)] for r in files.truth_source(spark, str(folder), form, range_bytes).collect()), key=repr)
    got = read("json")
    assert len(got) == len(documents)
    assert got == read("json_record")


def test_tasks_follow_the_bytes_not_the_ranges(spark, tmp_path):
    """A task per small range cost more than its reading."""
    rng = random.Random(3)
    (tmp_path / "t.json").write_text(json.dumps({"documents": [truth_document(rng, i) for i in range(300)]}))
    found = files.truth_source(spark, str(tmp_path), range_bytes=64)
    assert found.count() == 300 and found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    gigabyte = 1 << 30
    assert jsonsplit.reading_tasks(6 * gigabyte >> 16, 6 * gigabyte, 12) == 768
    assert jsonsplit.reading_tasks(3, 100, 12) == 3 and jsonsplit.reading_tasks(0, 0, 12) == 1


def test_odd_files(spark, tmp_path):
    cases = {
        "empty": b"", "blank": b" \n", "list": b'[{"documents":[{"document_id":"no"}]}]', "text": b'"documents"', "mark": b'\xef\xbb\xbf{"documents":[{"document_id":"bom"}]}',
        "cut": b'{"documents":[{"document_id":"whole"},{"document_id":"cu', "mixed": b'{"documents":[null,5,"x",[{"document_id":"no"}],{"document_id":"object"}]}',
        "object": b'{"documents":{"a":{"document_id":"no"}}}', "far": b'{"documents"' + b" " * 9000 + b":" + b"\n" * 9000 + b'[{"document_id":"far"}]}',
    }
    for name, content in cases.items():
        (tmp_path / f"{name}.json").write_bytes(content)
    for size in (5, 100, 1 << 20):
        found = jsonsplit.member_objects(manifest.manifest_scan(spark, str(tmp_path)), "documents", size, tasks=4)
        assert sorted(json.loads(r.text)["document_id"] for r in found.collect()) == ["bom", "far", "object", "whole"]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    (tmp_path / "truth.json").write_text(json.dumps({"documents": [truth_document(rng, i) for i in range(3000)]}))
    size = os.path.getsize(tmp_path / "truth.json")
    found = jsonsplit.member_objects(manifest.manifest_scan(spark, str(tmp_path / "truth.json")), "documents", size // 16 + 1)
    counts = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in counts) == 3000 and len(counts) >= 8 and max(r["count"] for r in counts) < 1000
