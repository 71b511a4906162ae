"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from comparing import same_rows

from docsieve.llm import exact_dedup, graph, minhash, substring_dedup, suffix_dedup


def by_text(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return groups


def expected_exact(rows):
    out = []
    for text, ids in by_text(rows).items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out


def test_exact(docs, docs_rows, clashing, no_docs):
    assert same_rows(exact_dedup.exact_dedup(docs).collect(), expected_exact(docs_rows))
    assert same_rows(exact_dedup.exact_dedup(clashing).collect(), expected_exact(docs_rows))
    assert exact_dedup.exact_dedup(no_docs).collect() == []


def test_exact_splits_buckets_and_doubles(docs, docs_rows):
    entries = docs.selectExpr("doc_id as entry_doc", "text").mapInArrow(exact_dedup._entries, exact_dedup.ENTRY)
    index, directory = exact_dedup.build_index(entries, capacity=4)
    sizes = index.groupBy("depth", "slot").agg({"key": "count"}).collect()
    assert max(r.depth for r in sizes) > 2 and {(r.depth, r.slot) for r in sizes} == set(directory)
    keys = index.select("depth", "slot", "key").distinct().collect()
    assert max(Counter((r.depth, r.slot) for r in keys).values()) <= 4
    assert all(r.slot == (r.key >> (63 - r.depth) if r.depth else 0) for r in keys)
    assert same_rows(exact_dedup.exact_dedup(docs, capacity=4).collect(), expected_exact(docs_rows))


def test_exact_chains_compare_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([7, 7, 7, 8]), pa.array([1, 2, 3, 4]), pa.array(["a", "b", "a", "b"]), pa.array(["s"] * 4)], names=["key", "entry_doc", "text", "entry_sha"])
    assert next(exact_dedup._chain(iter([batch]))).column("link").to_pylist() == [0, 1, 0, 0]


def test_exact_rows_keep_one_of_each(docs, docs_rows, clashing):
    kept = exact_dedup.exact_dedup_rows(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted(by_text(docs_rows))
    assert {r.doc_id for r in kept.collect()} == {max((i for i in ids if i is not None), default=None) for ids in by_text(docs_rows).values()}


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(size)))) if len(w) >= size else ({tuple(w)} if w else set())


def expected_near(rows, size, percent):
    n = len(rows)
    sets = [shingles(r[1], size) for r in rows]
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            common = len(sets[i] & sets[j])
            linked = common and 100 * common >= percent * len(sets[i] | sets[j])
            if linked or (rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i]):
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    out = []
    for i, r in enumerate(rows):
        component = least.get(find(i)) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), component, r[0] == component))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near(docs, docs_rows, size):
    assert same_rows(minhash.near_duplicates(docs, shingle=size).collect(), expected_near(docs_rows, size, 80))


def test_near_odd_inputs(clashing, docs_rows, no_docs):
    assert same_rows(minhash.near_duplicates(clashing).collect(), expected_near(docs_rows, 2, 80))
    assert minhash.near_duplicates(no_docs).collect() == []


def test_near_large_group_of_different_copies(spark):
    """One group of 300 texts that all differ and share rare shingles, and strangers that share some of them."""
    rng = random.Random(4)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(base[: 40 + i] + [f"y{i}-{j}" for j in range(60)])) for i in range(20)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert same_rows(got.collect(), expected_near(rows, 2, 80))


def test_keep_one(docs, docs_rows):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    names = {r[0] for r in expected_near(docs_rows, 5, 80) if r[3]}
    assert {r.doc_id for r in kept.collect()} == names
    assert all(c == 1 for i, c in Counter(r.doc_id for r in kept.collect()).items() if i is not None)


def test_keep_one_without_ids(spark):
    """Of a group without ids one row stays, of a group with one none without; an id does not keep the copies it has elsewhere."""
    def text(name, changed=None):
        return " ".join("other" if i == changed else f"{name}{i}" for i in range(120))

    blank = [(None, None), (None, " "), (None, " "), (8, ""), (8, "")]
    rows = [(None, text("a")), (None, text("a", 0)), (None, text("a", 119)), (None, text("a")), (None, text("b").upper()), (None, text("b")),
            (None, text("c", 0)), (3, text("c")), (5, text("c").upper()), (5, text("d")), (5, text("d")), (5, text("D")), *blank]
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert set(kept) <= set(rows)
    of = Counter((i, (t or "").lower().split()[-1][0] if (t or "").strip() else t) for i, t in kept if t is None or "other" not in t)
    of += Counter((i, t.split()[1][0]) for i, t in kept if t and "other" in t)
    assert of == Counter({(None, "a"): 1, (None, "b"): 1, (3, "c"): 1, (5, "d"): 1, (None, None): 1, (None, " "): 1, (8, ""): 1})


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1300)]
    loose = [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(90)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain + star + loose, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in chain + star + loose:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {x for a, b in chain + star + loose if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def expected_repeats(rows, k):
    order = lambda i: 2**63 - 1 if i is None else i
    first = {}
    texts = [(r[1] or "").encode().split() for r in rows]
    for r, w in zip(rows, texts):
        for a in range(len(w) - k + 1):
            key = tuple(w[a:a + k])
            first[key] = min(first.get(key, 2**63), order(r[0]))
    out = []
    for r, w in zip(rows, texts):
        keep = np.ones(len(w), bool)
        for a in range(len(w) - k + 1):
            if first[tuple(w[a:a + k])] < order(r[0]):
                keep[a:a + k] = False
        text = b" ".join(x for x, y in zip(w, keep) if y)
        out.append((r[0], len(w), int((~keep).sum()), hashlib.sha256(text).hexdigest(), text.decode()))
    return out


def test_substrings(docs, docs_rows, clashing, no_docs):
    want = expected_repeats(docs_rows, 13)
    assert sum(r[2] for r in want) > 400
    assert same_rows(substring_dedup.remove_repeats(docs).collect(), want)
    assert same_rows(substring_dedup.remove_repeats(clashing).collect(), want)
    assert substring_dedup.remove_repeats(no_docs).collect() == []


def expected_strings(rows, k):
    count = Counter()
    texts = [(r[1] or "").encode() for r in rows]
    for b in texts:
        count.update(b[a:a + k] for a in range(len(b) - k + 1))
    out = []
    for r, b in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - k + 1):
            if count[b[a:a + k]] > 1:
                gone[a:a + k] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((r[0], len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest(), bytearray(kept)))
    return out


def test_strings(docs, docs_rows, clashing, no_docs):
    want = expected_strings(docs_rows, 400)
    assert 0 < sum(1 for r in want if 0 < r[2] < r[1]) and sum(r[2] for r in want) > 5000
    assert same_rows(suffix_dedup.remove_repeated_strings(docs).collect(), want)
    assert same_rows(suffix_dedup.remove_repeated_strings(clashing).collect(), want)
    assert suffix_dedup.remove_repeated_strings(no_docs).collect() == []


def test_strings_of_a_minimizer_with_many_contents(docs, docs_rows, monkeypatch, spark):
    """Groups dealt over several sorts still meet."""
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(450))
    rows = [(i, "".join(rng.choice("klmnop ") for _ in range(300)) + passage[i % 9: 450 - i % 5] + "".join(rng.choice("uvwxyz ") for _ in range(300)))
            for i in range(60)]
    monkeypatch.setattr(suffix_dedup, "RUN", 4)
    got = suffix_dedup.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert same_rows(got, expected_strings(rows, 400))


def test_suffix_sort_orders_and_finds_repeats():
    rng = random.Random(6)
    contents = [(g, bytes(rng.choice(b"ab") for _ in range(rng.randrange(12, 60)))) for g in range(5) for _ in range(g + 1)]
    found = suffix_dedup.repeated_starts([(g, b, np.arange(len(b) - 11)) for g, b in contents], 12)
    for (g, raw), (marks, _) in zip(contents, found):
        pool = Counter(b[a:a + 12] for h, b in contents if h == g for a in range(len(b) - 11))
        assert marks.tolist() == [pool[raw[a:a + 12]] > 1 for a in range(len(raw) - 11)]
    kinds = {(g, raw[a:a + 12]) for g, raw in contents for a in range(len(raw) - 11)}
    assert sum(int(first.sum()) for _, first in found) == len(kinds)
    data = np.frombuffer(contents[-1][1], np.uint8)
    for limit in (5, 12):
        start = np.arange(len(data) - 11)
        order = suffix_dedup.sorted_suffixes(suffix_dedup._Suffixes(data, start, limit), np.zeros(len(start), int))
        assert [data[s:s + limit].tobytes() for s in start[order]] == sorted(data[s:s + limit].tobytes() for s in start)


def test_every_window_holds_a_block():
    for anchor in (0, 150, 368):
        count = anchor + 1
        assert suffix_dedup.wanted_windows(anchor, (1 << 8) - 1, count, 400).tolist() == list(range(count))
        assert all(0 <= anchor - t - (400 - 50 * (j + 1)) <= 50 for j in range(8) for t in suffix_dedup.wanted_windows(anchor, 1 << j, count, 400))


def test_texts_of_pairs_pass_a_filter_before_they_move(spark, tmp_path, monkeypatch):
    """All texts went through an exchange to find those of the pairs."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(150))) for i in range(2000)]
    rows += [(5000 + i, rows[i][1] + " tail") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    plans, write = {}, minhash.written

    def seen(df, name, **settings):
        before = {key: spark.conf.get(key) for key in settings}
        for key, value in settings.items():
            spark.conf.set(key, value)
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        for key, value in before.items():
            spark.conf.set(key, value)
        return write(df, name, **settings)
    monkeypatch.setattr(minhash, "written", seen)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.read.parquet(f"{tmp_path}/docs")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "might_contain" in plans["pair-texts"]
    assert all(got[5000 + i] == got[i] for i in range(40)) and len(got) == 2040
    assert spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold") != "1m"
