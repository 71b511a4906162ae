"""Recall of repeated passages by their length in bytes (operator 5 removes 400-byte strings)."""

import random

from docsieve.llm import suffix_dedup


def planted(rng, size):
    """Words that fill exactly ``size`` bytes."""
    text = ""
    while len(text) < size:
        text += "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) + " "
    return text[: size - 1] + "."


def test_recall_by_length(spark):
    rng = random.Random(11)
    sizes = [60, 200, 300, 380, 399, 400, 401, 450, 700, 2000, 9000]
    rows, passages = [], []
    for size in sizes:
        for _ in range(8):
            own = planted(rng, size)
            passages.append((size, own))
            for copy in "ABC"[: rng.choice([2, 2, 3])]:  # what stands around a copy differs from the first byte on
                rows.append((len(rows), planted(rng, rng.randrange(50, 3000)) + copy + own + copy + planted(rng, rng.randrange(50, 3000))))
    rng.shuffle(rows)
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    recall = {size: [] for size in sizes}
    for size, own in passages:
        for doc_id, text in rows:
            if own in text:
                recall[size].append(text.replace(own, "") == kept[doc_id])
    for size, found in recall.items():
        share = sum(found) / len(found)
        assert share == (1.0 if size >= 400 else 0.0), (size, share)
        if size < 400:  # shorter ones stay, and their documents with them
            assert all(kept[d] == t for d, t in rows if any(o in t for s, o in passages if s == size))
