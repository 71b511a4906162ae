"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget from its weight.  Complete epochs come first: a source
whose budget is 1.4 times its size is taken once whole.  The fraction that remains is a
weighted sample without replacement: each document draws the exponential key
-ln(u) / quality weight, and the smallest keys are taken until their sizes, summed in key
order, reach the budget; the document at the edge gives the words that are missing.

The prefix sum needs no task that holds a whole source.  Keys fall into a fixed number of
slices; sums per (source, slice) say in which slice the budget ends, and only the
documents of that slice are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.common import written

SLICES = 4096
WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), at_most: float = 2.0) -> DataFrame:
    """Targets of the sources (source, source_size): weighted shares, capped, the excess dealt anew.

    Water filling in closed form: with sources ordered by cap / weight, the first j are
    capped and the others share what is left by weight; j is the first for which the next
    source stays under its cap.  One row per source, so the windows here are small.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    listed = sizes.withColumn("__i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int"))
    ranked = listed.withColumn("w", weight).withColumn("cap", F.lit(at_most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    everything = Window.partitionBy(F.lit(1))
    before = everything.orderBy("ratio", "__i").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
    ranked = ranked.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # filling level if exactly the sources before this one are capped
    ranked = ranked.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("w_left"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "__i", "level"))).over(everything).getField("level")
    return ranked.withColumn("target", F.least("cap", F.coalesce(level * F.col("w"), "cap"))).select("source", "source_size", "target")


def _sized(docs: DataFrame, quality: DataFrame | None, neutral: float, slices: int, carry: list[str]) -> DataFrame:
    """Documents with size, hash, exponential key and slice; ``carry`` names the columns that stay."""
    text = F.col("text").cast("string")
    rows = docs.select(
        *[F.col(c).alias(f"__{c}") for c in carry], F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("sha"))
    if quality is not None:
        best = quality.groupBy(F.col("doc_id").cast("long").alias("q_id")).agg(F.max("quality_weight").alias("q"))
        rows = rows.join(best, F.col("doc_id") == F.col("q_id"), "left").withColumn("q", F.coalesce("q", F.lit(neutral))).drop("q_id")
    else:
        rows = rows.withColumn("q", F.lit(1.0))
    uniform = (F.shiftrightunsigned("sha", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    # 1 - exp(-key) lies between 0 and 1 and grows with the key
    return rows.withColumn("key", -F.log(uniform) / F.col("q")).withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * slices)).drop("q")


def _plan(sized: DataFrame, share: float, weights: tuple[float, ...], at_most: float) -> DataFrame:
    """One row per source: target, epochs, rest of the budget, and the slice in which it ends."""
    sums = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    ends = sums.withColumn("start", F.coalesce(F.sum("slice_size").over(
        Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slices = ends.groupBy("source").agg(
        F.sum("slice_size").alias("source_size"), F.sort_array(F.collect_list(F.struct("slice", "start", "slice_size"))).alias("ends"))
    targets = source_targets(slices.select("source", "source_size"), share, weights, at_most)
    known = slices.drop("source_size").join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    cut = F.expr("get(filter(ends, e -> e.start < rest and e.start + e.slice_size >= rest), 0)")
    return known.withColumn("epochs", epochs).withColumn("rest", rest).withColumn("cut", cut).select(
        "t_source", "source_size", "target", "epochs", "rest", F.coalesce(F.col("cut.slice"), F.lit(-1)).alias("cut_slice"), F.col("cut.start").alias("cut_start"))


def _taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    clear = placed.filter("slice <> cut_slice").withColumn("extra", F.when(F.col("slice") < F.col("cut_slice"), F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "sha").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.filter("slice = cut_slice").withColumn("extra", F.greatest(F.lit(0), F.least(
        F.col("size"), F.col("rest") - F.col("cut_start") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    return clear.unionByName(edge).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long"))


def mix_sources(
    docs: DataFrame, quality: DataFrame | None = None, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1),
    at_most: float = 2.0, neutral: float = 0.7, slices: int = SLICES,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source.

    ``quality`` is (doc_id, quality_weight) with weights over 0; other documents weigh
    ``neutral``.  Null and empty texts have size 0 and are taken 0 times; null is a source
    of its own, the last.  Equal keys (rows repeated with one id) are ordered by id and text;
    each row counts.  The keys are hashes of id and text, so reruns agree.  Very long texts
    count with all their words.  Other columns are ignored; an empty table gives no rows.
    """
    sized = written(_sized(docs, quality, neutral, slices, []), "mix-keys")
    plan = written(_plan(sized, share, weights, at_most), "mix-plan")
    return _taken(sized, plan).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_rows(
    docs: DataFrame, quality: DataFrame | None = None, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1),
    at_most: float = 2.0, neutral: float = 0.7, slices: int = SLICES,
) -> DataFrame:
    """The mix itself: each document as often as it is taken whole, then once more if taken in part.

    All columns stay.  The document at a budget's end is cut to its first words, joined by
    one space, and its n_chars, if there is such a column, follows.  Texts are shuffled only
    where they lie in the slice in which a budget ends (or to meet ``quality``).  Null and empty
    texts are never taken; repeated rows, nulls and ties are as in ``mix_sources``; an empty table
    gives no rows.
    """
    sized = _sized(docs, quality, neutral, slices, docs.columns)
    plan = written(_plan(written(sized.select("source", "slice", "size"), "mix-sizes"), share, weights, at_most), "mix-plan")
    taken = _taken(sized, plan).filter("taken > 0").withColumn("__left", F.explode(F.expr(
        "filter(transform(sequence(0, 2 + cast(epochs as int)), i -> least(size, taken - i * size)), x -> x > 0)")))
    part = F.col("__left") < F.col("size")
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("__text").cast("string"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("__left").cast("int")), " ")
    taken = taken.withColumn("__text", F.when(part, head).otherwise(F.col("__text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        taken = taken.withColumn("__n_chars", F.when(part, F.length("__text").cast(kind)).otherwise(F.col("__n_chars")))
    return taken.select(*[F.col(f"__{c}").alias(c) for c in docs.columns])
