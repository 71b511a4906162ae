"""Mixing, packing and fingerprints against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from comparing import same_rows

from docsieve.llm import fingerprint, mixing, packing
from docsieve.llm.queries import tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, share=1.5, weights=(5, 2, 1), at_most=2.0):
    """Targets by repeated dealing, in order of source (null last)."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        rest = share * sum(sizes.values()) - sum(target.values())
        over = {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > at_most * sizes[s]}
        if not over:
            target.update({s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_})
            break
        target.update({s: at_most * sizes[s] for s in over})
        open_ -= over
    return target


def check_mix(rows, got):
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORDS.findall(r[1] or ""))
    want = filled(size)
    assert same_rows([(r.doc_id, r.size, r.source_size) for r in got], [(r[0], len(WORDS.findall(r[1] or "")), size[r[3]]) for r in rows])
    taken = Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in want)


def test_mix(docs, docs_rows, clashing, no_docs):
    got = mixing.mix_sources(docs).collect()
    check_mix(docs_rows, got)
    again = mixing.mix_sources(clashing.repartition(3)).collect()
    assert same_rows(got, again)
    assert mixing.mix_sources(no_docs).collect() == []


@pytest.mark.parametrize("slices", [1, 7])
def test_mix_slices(docs, docs_rows, slices):
    check_mix(docs_rows, mixing.mix_sources(docs, slices=slices).collect())


def test_mix_is_a_prefix_of_the_keys(docs, docs_rows):
    """Within a source every document taken once more has a smaller key than one that is not."""
    sized = mixing._sized(docs, None, 0.7, 64, []).collect()
    key = {(r.doc_id, r.sha): r.key for r in sized}
    taken = mixing._taken(mixing._sized(docs, None, 0.7, 64, []), mixing._plan(mixing._sized(docs, None, 0.7, 64, []), 1.5, (5, 2, 1), 2.0)).collect()
    for source in {r.source for r in taken}:
        own = [r for r in taken if r.source == source and r.size]
        last = max((key[r.doc_id, r.sha] for r in own if r.extra), default=-1)
        assert all(r.extra == r.size or key[r.doc_id, r.sha] >= last for r in own)


def test_mix_prefers_quality(spark):
    rows = [(i, "w " * 50, None, f"s{i % 2}", 100) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    quality = spark.createDataFrame([(i, 1.0 if i < 1000 else 0.1) for i in range(2000)] + [(None, 1.0)], "doc_id long, quality_weight double")
    got = mixing.mix_sources(docs, quality, share=0.4).collect()
    good = sum(r.taken for r in got if r.doc_id < 1000)
    assert good > 4 * sum(r.taken for r in got if r.doc_id >= 1000)


def test_mixed_rows(docs, clashing, docs_rows, no_docs):
    rows = mixing.mixed_rows(clashing).collect()
    assert mixing.mixed_rows(clashing).columns == clashing.columns
    words = Counter()
    for r in rows:
        words[r.doc_id, r.source] += len(WORDS.findall(r.text))
        assert r.n_chars == len(r.text)
    taken = Counter()
    for r in mixing.mix_sources(docs).collect():
        taken[r.doc_id, r.source] += r.taken
    assert words == +taken
    assert mixing.mixed_rows(no_docs).collect() == []


def pieces_of(rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    out = []
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(r[0], k // capacity, k, len(ids[k:k + capacity]), zlib.crc32(ids[k:k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    return out


def check_packing(got, capacity):
    ends = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= capacity
    return len(ends)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(docs, docs_rows, clashing, no_docs, capacity):
    got = packing.pack_documents(clashing, tokenizer_path(), capacity).collect()
    assert same_rows([tuple(r)[:5] for r in got], pieces_of(docs_rows, capacity))
    n = check_packing(got, capacity)
    assert n <= -(-sum(r.length for r in got) // capacity) * 1.05 + 1
    assert packing.pack_documents(no_docs, tokenizer_path()).collect() == []


def test_packing_in_blocks(docs):
    got = packing.pack_documents(docs, tokenizer_path(), 256, block=20).collect()
    check_packing(got, 256)


def test_pack_block_beats_best_fit_and_keeps_all():
    rng = random.Random(1)
    cases = [[rng.randint(1300, 2100) for _ in range(300)], [1] * 3000 + [4000] * 20, [rng.choice([2049, 2047, 2048, 1366, 1365]) for _ in range(500)], [], [4095], [7] * 5]
    for lengths in cases:
        bins = packing.pack_block(lengths)
        assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= 4096 for b in bins)
        assert len(bins) <= len(packing._best_fit(packing._Stock(lengths), 4096))
    # best fit decreasing needs four here
    lengths = [6, 5, 5, 4, 4, 3, 3]
    assert len(packing.pack_block(lengths, 10)) == 3


def test_fillings_are_maximal():
    stock = packing._Stock([5, 4, 3, 3, 2])
    for filling in packing._fillings(stock, 7, 7, [1000]):
        left = 7 - sum(filling)
        rest = Counter([5, 4, 3, 3, 2]) - Counter(filling)
        assert left >= 0 and all(x > left for x in rest)
    assert stock.count == {5: 1, 4: 1, 3: 2, 2: 1}


def slow_boundaries(data):
    """The chunking rule, byte by byte."""
    ends, start = [], 0
    gear = fingerprint.gear_hash(data) if len(data) else data
    while len(data) - start > fingerprint.LEAST:
        for end in range(start + fingerprint.LEAST, len(data) + 1):
            bits = fingerprint.STRICT if end - start < fingerprint.USUAL else fingerprint.LOOSE
            if int(gear[end - 1]) >> (16 - bits) == 0 or end - start == fingerprint.MOST:
                break
        ends.append(end)
        start = end
    return ends + [len(data)] * (start < len(data))


def test_boundaries_follow_the_rule():
    rng = np.random.default_rng(5)
    for n in (0, 1, 8, 9, 20, 21, 500, 5000):
        data = rng.integers(97, 105, n).astype(np.uint8)
        assert fingerprint.boundaries(data) == slow_boundaries(data)
    gear = fingerprint.gear_hash(data)
    table = fingerprint._GEAR.astype(int)
    for i in (0, 3, 15, 16, 400):
        assert gear[i] == sum(table[data[i - j]] << j for j in range(min(i + 1, 16))) % 2**16
    moved = fingerprint.chunk_set(np.concatenate([data[:9] + 1, data]))
    assert fingerprint.containment(fingerprint.chunk_set(data), moved) > 0.97


@pytest.mark.parametrize("per_block", [1000, 7])
def test_fingerprints(docs, docs_rows, clashing, no_docs, per_block):
    got = fingerprint.fingerprints(clashing, per_block).collect()
    order = sorted([(r[0], r[1] or "") for r in docs_rows], key=lambda r: (-r[0] if r[0] is not None else 1, r[1]))
    texts = [t for _, t in order]
    want = []
    for (doc_id, text), after in zip(order, texts[1:] + texts[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        sets = [fingerprint.chunk_set(np.frombuffer(t.encode(), np.uint8)) for t in (text, edited, after)]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.encode(sets[0]), fingerprint.encode(sets[1]),
                     fingerprint.containment(sets[0], sets[1]), fingerprint.containment(sets[0], sets[2])))
    assert same_rows(got, want)
    assert fingerprint.fingerprints(no_docs, per_block).collect() == []


def test_likeness(docs):
    rows = fingerprint.fingerprints(docs).collect()
    usual = [r.near_edited for r in rows if r.n_chars > 300]
    assert 0.5 < np.mean(usual) < 0.8
    assert fingerprint.containment(*[np.zeros(0, np.uint64)] * 2) == 1.0


@pytest.mark.parametrize("ids", [
    [*range(1400), *[1 << 60] * 100], [*range(1400), *[(1 << 60) + 1] * 60, *[1 << 60] * 40], [-(1 << 63), (1 << 63) - 1, *range(-50, 50), *[(1 << 63) - 2] * 30, *[-(1 << 63)] * 30],
    [(1 << 62) + i for i in range(300)], [-(1 << 63), (1 << 63) - 1], [7] * 40])
def test_fingerprints_of_repeated_and_far_apart_ids(spark, ids):
    """Blocks are cut in whole numbers: neighbouring ids beyond 2^53 and both ends of the range."""
    table = [(i, f"text {n % 90} of {i}") for n, i in enumerate(ids)]
    got = fingerprint.fingerprints(spark.createDataFrame(table, "doc_id long, text string"), 20).collect()
    order = sorted(table, key=lambda r: (-r[0], r[1]))
    want = sorted((i, len(t), hashlib.sha256(fingerprint.edited_text(t, after).encode()).hexdigest()) for (i, t), (_, after) in zip(order, order[1:] + order[:1]))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want


def test_a_worker_keeps_few_parts_of_words():
    """Up to 700,000 parts stayed in each worker, besides the words that they make up."""
    path, rng = tokenizer_path(), random.Random(3)
    for _ in range(12):
        chunks = sorted({f"{rng.randrange(10**9):x}-{rng.randrange(10**9):x}".encode() for _ in range(12_000)})
        found = packing.chunk_tokens(chunks, path)
    assert found[:50] == packing.token_bytes(chunks[:50], path)
    memo = packing._tokenizer(path)[2]
    assert len(memo.new) + len(memo.old) < 150_000
