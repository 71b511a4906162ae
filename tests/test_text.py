import pytest
from pyspark.sql import functions as F

from docsieve.functions import dims, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("raw", "expected"), [
    ("  INV-001.  ", "INV-001"), ("unknown", None), ("Unknown.", None), ('"quoted"', "quoted"), ("' a ' ;,", "a '"),
    ("<value>", None), ("<a<b>", "<a<b>"), ("N/A", None), ("--", None), ("", None), (" \n\t", None), (None, None),
    ("keep, inner. dots", "keep, inner. dots"), (" x ", "x"), ("not visible in document.", None),
])
def test_norm_text(spark, raw, expected):
    assert one(spark, text.norm_text(F.lit(raw).cast("string"))) == expected


def test_norm_value_passes_other_kinds(spark):
    for kind, value, expected in [("number", "20.0", "20.0"), ("boolean", "True", "True"), ("null", None, None), ("array", "[1].", "[1]."), ("string", "x.", "x")]:
        assert one(spark, text.norm_value(F.lit(value).cast("string"), F.lit(kind))) == expected


@pytest.mark.parametrize(("raw", "expected"), [
    ("Invoice No", "invoice_number"), (" Net Pay ", "net_salary"), ("Total-Amount:", "amount"), ("Vendor", "vendor"), ("***", ""), ("Été", "t"),
])
def test_norm_field_name(spark, raw, expected):
    assert one(spark, text.norm_field_name(F.lit(raw))) == expected


@pytest.mark.parametrize(("a", "b", "same"), [
    ("Alice Example.", "alice example", True), (None, "alice", False), (None, None, True), ("1,000", "1000", False),
    ("-5.00", "5.00", True), ("Café", "CAFÉ", True), ("Cafe", "Café", False), ("a#b", "a b", True), ("..", None, True), ("20.0", "20", False),
])
def test_exact_match(spark, a, b, same):
    assert one(spark, text.exact_match(F.lit(a).cast("string"), F.lit(b).cast("string"))) is same


def test_strip_covers_all_white_space(spark):
    every = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert one(spark, text.strip(F.lit(every + "a b" + every))) == "a b"


def test_lines_split_like_text_tools(spark):
    raw = "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h\ni"
    assert [x for x in one(spark, text.lines(F.lit(raw))) if x] == raw.splitlines()


@pytest.mark.parametrize(("decoded", "prompt", "expected"), [
    ("User: q\nAssistant: one\nAssistant: two \n", "q", "two"),
    ("<|im_start|>user q<|im_start|>assistant\n hi", "q", "hi"),
    ("say hi  hello", "say hi", "hello"), ("  plain ", "absent", "plain"), ("  plain ", "", "plain"),
    ("p x p y", "p", "x p y"),
])
def test_reply_strip_chat(spark, decoded, prompt, expected):
    assert one(spark, text.reply_strip_chat(F.lit(decoded), F.lit(prompt))) == expected


def test_ratio4_rounds_like_exact_binary(spark):
    pairs = [(c, t) for t in (1, 3, 7, 32, 96, 160, 800, 4000, 20000) for c in range(0, min(t, 400) + 1)]
    got = spark.createDataFrame(pairs, "c int, t int").select("c", "t", text.ratio4(F.col("c"), F.col("t")).alias("r")).collect()
    assert all(r.r == round(r.c / r.t, 4) for r in got)
    assert one(spark, text.ratio4(F.lit(1), F.lit(0))) is None


def test_dimensions(spark):
    assert dims.dim_schema(spark).count() == 25
    assert dims.dim_field_alias(spark).count() == 42
    assert dims.dim_type_phrase(spark).count() == 21
    assert dims.dim_task(spark).groupBy("family").count().count() == 2


def test_the_kernels_names_and_values_are_those_of_the_columns(spark):
    import random

    from docsieve.functions import dims, text

    rng = random.Random(11)
    bits = [*text.WHITESPACE, *"aZ09_.,;-'\"<>/#é", "İ", "K", "ß", "N/A", "not visible", "Unknown", "Customer Name", "invoice no", "😀".encode("utf-16", "surrogatepass").decode("utf-16")]
    some = ["".join(rng.choice(bits) for _ in range(rng.randrange(7))) for _ in range(3000)] + [*dims.NULL_TOKENS, *dims.FIELD_ALIASES, "<value>", "<a\nb>", "<a><b>"]
    found = spark.createDataFrame([(t,) for t in some], "t string").select("t", text.norm_field_name(F.col("t")).alias("name"), text.norm_text(F.col("t")).alias("value")).collect()
    assert [(r.name, r.value) for r in found] == [(text.canonical_name(r.t), text.clean_text(r.t)) for r in found]
