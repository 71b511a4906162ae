"""Whitening, centroid clustering and chat formatting against plain models."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import centroids, chat_format, whitening
from docsieve.llm.spectrum import Spectrum

VECTORS = "vec_id long, embedding array<float>, n string, slot string, x string, cluster string, dots string, total string"
NAN, INF = float("nan"), float("inf")


def vector_rows(size, number, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i * 2, [float(v) for v in np.float32(r)]) for i, r in enumerate(rng.normal(size=(number, size)) * np.linspace(0.02, 0.4, size))]
    rows += [rows[4], rows[4], (None, rows[5][1]), (rows[6][0], rows[7][1])]  # repeated rows and ids
    odd = [(1, None), (3, []), (5, [0.5] * (size - 1)), (7, [0.5] * (size - 1) + [None]), (9, [NAN] + [0.1] * (size - 1)), (11, [INF] * size), (13, [0.25] * (size + 1))]
    return rows, odd


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, *["own"] * 6) for i, v in rows], VECTORS).repartition(5)


# ---- whitening -----------------------------------------------------------------------


@pytest.mark.parametrize("case", ["plain", "ties", "few dimensions", "constant", "one row", "row by row"])
def test_spectrum_by_rank_one_updates(case):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12)) * np.linspace(0.1, 3, 12) + 5
    if case == "ties":
        x = np.repeat(np.eye(12), 20, axis=0)
    elif case == "few dimensions":
        x = x[:, :3] @ rng.normal(size=(3, 12))
    elif case == "constant":
        x = np.full((50, 12), 7.0)
    elif case == "one row":
        x = x[:1]
    step = 1 if case == "row by row" else 70
    parts = []
    for half in (x[:180], x[180:]):
        part = Spectrum.empty(12)
        for i in range(0, len(half), step):
            part.add(half[i: i + step])
        parts.append(part)
    parts[0].merge(parts[1])
    own = parts[0]
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    assert own.n == len(x) and np.allclose(own.mean, x.mean(axis=0))
    assert np.allclose(own.vectors.T @ own.vectors, np.eye(12), atol=1e-10)
    assert np.allclose(own.vectors @ np.diag(own.values) @ own.vectors.T, scatter, atol=1e-7 * max(1, np.abs(scatter).max()))


def expected_whitening(rows, components=8):
    x = np.floor(np.array([r[1] for r in rows], float) * 1024).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total)) for row in x]
    return n, deviation, centred @ vectors[:, :components] / np.sqrt(values[:components]), values / values.sum()


def test_whitening_equals_numpy(spark):
    rows, odd = vector_rows(12, 400)
    out = whitening.whitened_components(vector_table(spark, rows + odd)).collect()
    n, deviation, white, explained = expected_whitening(rows)
    assert len(out) == 8 * len(rows) and {r.n for r in out} == {n}
    got = {}
    for r in out:
        got.setdefault((r.vec_id, r.deviation, r.component), []).append(r.whitened)
    # signs are free, but one for all rows of a component
    sign = [1 if max(got[rows[0][0], deviation[0], c + 1], key=abs) * white[0][c] > 0 else -1 for c in range(8)]
    for (vec_id, _), d, w in zip(rows, deviation, white):
        for c in range(8):
            assert any(abs(v - sign[c] * w[c]) < 1e-9 for v in got[vec_id, d, c + 1])
    assert all(abs(r.explained - explained[r.component - 1]) < 1e-9 for r in out)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9
    assert all(str(r.deviation) == r.deviation_exact for r in out)


def test_whitening_odd_tables(spark):
    _, odd = vector_rows(12, 10)
    assert whitening.whitened_components(vector_table(spark, [])).collect() == []
    assert whitening.whitened_components(vector_table(spark, [(1, None), (2, []), (3, [NAN])])).collect() == []
    # one vector: nothing varies; fewer dimensions than components; lengths in a minority have no rows
    out = whitening.whitened_components(vector_table(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(out, key=lambda r: r.component)] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    out = whitening.whitened_components(vector_table(spark, [(1, [0.5, 0.25]), (2, [0.75, 0.25]), *odd[:2], (8, [0.1] * 3)])).collect()
    assert {r.vec_id for r in out} == {1, 2}
    assert {(r.component, r.whitened is None) for r in out} == {(1, False), (2, True)}
    # integers past a long: exact as text, null as long
    out = whitening.whitened_components(vector_table(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0])])).collect()
    assert all(r.deviation is None and int(r.deviation_exact) == (2 * (1 << 40)) ** 2 for r in out)


# ---- centroid clustering ---------------------------------------------------------------


def expected_clusters(rows, k, rounds, size):
    xs = [[int(np.floor(64 * np.float64(v))) for v in vector] for _, vector in rows]
    order = sorted(range(len(xs)), key=lambda i: (hashlib.sha256(f"1:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), xs[i]))
    cs = [xs[i] for i in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        member = [near(x)[1] for x in xs]
        for j in range(len(cs)):
            own = [x for x, m in zip(xs, member) if m == j]
            if own:
                cs[j] = [sum(col) // len(own) for col in zip(*own)]
    found = [near(x) for x in xs]
    by = [sum(d for d, m in found if m == j) for j in range(len(cs))]
    return sorted(((i, m, d, by[m], sum(by), hashlib.sha256(",".join(map(str, cs[m])).encode()).hexdigest()) for (i, _), (d, m) in zip(rows, found)), key=repr)


@pytest.mark.parametrize("number, size, k, rounds", [(300, 64, 16, 3), (40, 6, 5, 1), (3, 6, 16, 3), (60, 6, 4, 0)])
def test_clusters_equal_plain_rounds(spark, number, size, k, rounds):
    rows, odd = vector_rows(size, max(number, 10))
    rows = rows if number > 10 else rows[:number]
    out = centroids.centroid_clusters(vector_table(spark, rows + odd), k, rounds, 64, size).drop("centroid").collect()
    assert sorted(map(tuple, out), key=repr) == expected_clusters(rows, k, rounds, size)


def test_clusters_with_ties_and_empty_clusters(spark):
    rows = [(i, [0.5, 0.5]) for i in range(30)] + [(100 + i, [-0.5, 0.25]) for i in range(5)]  # equal centroids: the smaller number wins
    out = centroids.centroid_clusters(vector_table(spark, rows), 16, 3, 64, 2).drop("centroid").collect()
    assert sorted(map(tuple, out), key=repr) == expected_clusters(rows, 16, 3, 2)
    assert centroids.centroid_clusters(vector_table(spark, []), size=2).collect() == []
    assert centroids.centroid_clusters(vector_table(spark, [(1, None), (2, [1.0])]), size=2).collect() == []
    far = centroids.centroid_clusters(vector_table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0])]), 1, 1, 64, 2).collect()
    assert {r.distance for r in far} == {1 << 54}


# ---- chat formatting -------------------------------------------------------------------

EVENTS = "conv_id long, turn long, seq long, role string, kind string, text string, segment string, conv string, live string"


def event_table(spark, events):
    return spark.createDataFrame([(*e, *["own"] * 3) for e in events], EVENTS).repartition(4)


def folded(events):
    """Plain replay of a log: {conversation: {turn: [role, text]}}."""
    out = {}
    for conv, turn, seq, role, kind, text in sorted(events, key=lambda e: (e[0] is None, e[0] or 0, e[2])):
        turns = out.setdefault(conv, {})
        if kind == "regenerate":
            for later in [t for t in turns if t > turn]:
                del turns[later]
        if kind == "delta":
            own = turns.setdefault(turn, ["", ""])
            own[1] += text or ""
        else:
            own = turns[turn] = ["", text or ""]
        own[0] = role
    return out


def random_log(rng, conversations, steps):
    events = []
    for conv in [*range(conversations), None]:
        for seq in range(rng.randrange(1, steps)):
            turn = rng.randrange(0, 9)
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            events.append((conv, turn, seq, "assistant" if turn % 2 else "user", kind, rng.choice([None, "", f"<s>{seq} ", "a\\b", "[INST]é\U0001f600\n"])))
    return events


@pytest.mark.parametrize("segment", [2, 256])
def test_fold_of_deltas_edits_and_regenerations(spark, segment):
    events = random_log(random.Random(5), 40, 60)
    out = chat_format.reconstruct(event_table(spark, events), segment).collect()
    got = {}
    for r in out:
        got.setdefault(None if r.no_id else r.conv, {})[r.turn] = [r.role, r.text]
    assert got == {c: t for c, t in folded(events).items() if t}


def expected_digests(conversations):
    out = []
    for conv, turns in conversations.items():
        spoken = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        out.append((conv, len(turns), hashlib.sha256(spoken.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [2, 256])
def test_digests_read_back_from_formatted_text(spark, segment):
    events = random_log(random.Random(6), 30, 50)
    out = chat_format.chat_digests(event_table(spark, events), segment).collect()
    assert sorted((tuple(r)[:5] for r in out), key=repr) == expected_digests({c: [t[k] for k in sorted(t)] for c, t in folded(events).items() if t})


def test_control_strings_are_escaped_reversibly(spark):
    rng = random.Random(7)
    bits = [*chat_format.CONTROLS, "\\", "\\\\", "<", "[", "|", ">", "]", "\n", "INST", "é", "\U0001f600", "s", "/", "$1", "end"]
    texts = ["", *chat_format.CONTROLS, *["".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(400)]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "t", chat_format.escape(F.col("t")).alias("e")).select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(c in r.e for c in chat_format.CONTROLS)


def test_conversations_of_every_kind(spark):
    schema = "conv_id long, turn long, role string, text string, seq string, part string, kind string, segment string"
    long = "word </s> " * 3000
    table = [
        (1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", ""), (2, 5, "user", "tie"),
        (3, None, "system", "no turn"), (3, -(1 << 63), "user", "first"), (3, (1 << 63) - 1, "assistant", "last"), (None, 0, "user", "no id"), (None, 1, "assistant", "still none"),
        (4, 0, "user", "only <|end|> a question"), *[(5, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(700)],
    ]
    df = spark.createDataFrame([(*r, *["own"] * 4) for r in table], schema).repartition(3)
    out = chat_format.chat_digests(chat_format.as_events(df)).collect()
    by = {}
    for conv, turn, role, text in sorted(table, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    assert sorted((tuple(r)[:5] for r in out), key=repr) == expected_digests(by)
    assert {r.conv_id: r.loss_chars for r in out}[4] == 0
    empty = spark.createDataFrame([], schema)
    assert chat_format.chat_digests(chat_format.as_events(empty)).collect() == []


def test_formatted_text_and_mask(spark):
    events = event_table(spark, [(1, 0, 0, "user", "message", "a <s> b"), (1, 1, 1, "assistant", "message", ""), (1, 1, 2, "assistant", "delta", "yes "), (1, 1, 3, "assistant", "delta", "</s>")])
    row = chat_format.format_conversations(events).first()
    assert row.formatted == "<|turn|>user<|text|>a <\\s> b<|end|><|turn|>assistant<|text|>yes <\\/s><|end|>"
    assert [row.formatted[s.start: s.start + s.length] for s in row.loss_spans] == ["yes <\\/s>"]


def test_no_python_and_one_exchange_of_texts(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.reconstruct(chat_format.as_events(rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
