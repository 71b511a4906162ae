import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those the operators make or use inside.
CLASHING = ("k", "n", "digest", "sketch", "key", "sha", "size", "taken", "target", "slice", "block", "tail", "doc", "pos", "spans", "mini",
            "piece", "start", "length", "kept", "keep_id", "score", "predicted", "component_id", "link", "row", "v", "cls", "c", "extra")


def prose(rng, words):
    return " ".join(rng.choice("alpha Beta gamma delta, epsilon zeta. eta theta iota kappa Lambda mu".split()) + str(rng.randrange(40)) for _ in range(words))


def corpus():
    """Small documents with every oddity: (doc_id, text, lang, source, n_chars) rows."""
    rng = random.Random(8)
    base = [prose(rng, rng.randrange(1, 160)) for _ in range(40)]
    texts = list(base)
    texts += [base[3], base[3], base[7], base[7].upper(), base[9] + " tail"]  # copies, another case, a near copy
    words = base[11].split()
    texts += [" ".join(words[:k] + ["other"] + words[k + 1:]) for k in range(0, min(60, len(words)), 9)]  # near copies
    passage = prose(rng, 70)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(6)]
    texts += [None, None, "", "", " \t\n\x0b\x0c\r ", "one", "ONE", "two words", "x y z", "é́ ß \U0001f600 <|endoftext|> don't", "a" * 3000]
    texts += [" ".join(f"w{i % 700}" for i in range(12_000))]  # long, and it repeats itself
    rows = [(i * 3 + 1, t, rng.choice(["en", "de", None]), f"src{min(i % 4, 2)}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "no id at all", "en", "src0", 12), (None, base[3], None, None, len(base[3])), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs_rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
