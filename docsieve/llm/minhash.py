"""Near-duplicate documents from bottom-k sketches.

A document is the set of its word shingles.  One hash function orders all shingles; the
sketch of a document is its k least hashes (the whole set, where that is smaller).
Documents with the same set form a class, and only classes are compared.

Candidates come from inverted lists of retained values.  Two sets with a similarity of 0.8
share many retained values, so each class enters only the lists of its rarest ones: with at
least t common values among the sketches, one lies among the first size - t + 1 of each
class in the same order.  The order is by document frequency over all classes, so lists of
very common shingles stay out.  Every list entry carries a bit mask of its class's sketch, four
longs: two sketches with c common values share at least c bits, less those that collide inside one
of them.  So a pair is made only if its masks allow as many common values as any link has.  Pairs
are then filtered by the similarity that the sketch of the union estimates, and verified on the
full sets.

Lists never emit all their pairs.  Long lists first link their members to a hub, the member
that shares most (the text that the others were made from, as a rule), and the links so far
are contracted; then only members outside the list's largest component meet the members of
other components.  Two documents that are left unpaired by this are linked already, so the
components are those of all links.  Members of long lists that stay apart are alike but not
near duplicates as a rule; 32 values cannot tell, so they are listed again by deep sketches,
which hold whole sets: there the rarest fifth decides, and the differences of two sets from
their hub give their intersection before a pair is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import LOWER, counts_of, mix, prefix_hash, span_hash, text_blocks, words, written
from docsieve.llm.graph import components

SKETCH = 32
DEEP = 4096  # sketch of the classes in long lists: the whole set, but for very long texts
DIFFERENCES = 256  # most differences from a hub that are kept in lists; beyond, pairs are made and verified
LONG_LIST = 32  # longer lists are contracted around a hub first
MASKS = ("m0", "m1", "m2", "m3")  # 256 bits, one for each retained value


def least_common(k: int, percent: int) -> int:
    """Common values asked of two sketches of k values: six standard deviations below the mean.

    At similarity 0.8, 32 values of the union's sketch hold 25.6 common ones on average; 11 or
    fewer have a probability below 1e-7.
    """
    p = percent / 100
    return max(1, int(k * p - 6 * (k * p * (1 - p)) ** 0.5))


_TOP = np.uint64(1 << 63)
SKETCHED = "k struct<id: long, k: long, sha: string>, n long, digest binary, sketch array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a run of texts, sorted by (row, hash): (row, hash)."""
    start, end, row = words(data, offsets)
    n = len(offsets) - 1
    number, first = counts_of(row, n)
    word = span_hash(prefix_hash(LOWER[data]), start, end)
    hashes, rows = [], []
    if len(word) >= size:
        with np.errstate(over="ignore"):
            gram = word[: len(word) - size + 1].copy()
            for k in range(1, size):
                gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + word[k: len(word) - size + 1 + k])
        whole = row[: len(gram)] == row[size - 1:]
        hashes.append(gram[whole])
        rows.append(row[: len(gram)][whole])
    # shorter texts: their whole sequence is one shingle, told apart by its length
    for i in np.flatnonzero((number > 0) & (number < size)):
        h = np.uint64(number[i])
        with np.errstate(over="ignore"):
            for w in word[first[i]: first[i + 1]]:
                h = mix(np.array([h * np.uint64(0xD1B54A32D192ED03) + w]))[0]
        hashes.append(np.array([h], np.uint64))
        rows.append(np.array([i]))
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed, placed = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((hashed, placed))
    hashed, placed = hashed[order], placed[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (placed[1:] != placed[:-1])
    return placed[new], hashed[new]


def _sketch_task(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in text_blocks(batch.column(1)):
                n = end - begin
                row, h = shingle_sets(data, offsets, size)
                number, first = counts_of(row, n)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.uint64(salt)), dtype=np.uint64)]) for salt in (11, 13)]
                    digests = np.stack([mix(s[first[1:]] - s[first[:-1]] + number.astype(np.uint64)) for s in sums], 1)
                kept = np.minimum(number, k)
                retained = np.arange(len(h)) - first[:-1][row] < k
                # top bit flipped: signed order is hash order
                values = (h[retained] ^ _TOP).view(np.int64)
                raw = digests.astype(">u8").tobytes()
                digest = [raw[16 * i: 16 * i + 16] if number[i] else None for i in range(n)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, n), pa.array(number), pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(values)),
                ], names=["k", "n", "digest", "sketch"])
    return run


def _verify_task(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keep pairs whose full sets have 100 * intersection >= percent * union."""
        def shingles(text: bytes) -> set:
            w = text.lower().split()
            if len(w) < size:
                return {tuple(w)} if w else set()
            return set(zip(*(w[i:] for i in range(size))))

        hub, hub_set = None, set()  # rows come sorted by a
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            left, right, a = batch.column(2), batch.column(3), batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                if a[i] != hub:
                    hub, hub_set = a[i], shingles((left[i].as_py() or "").encode("utf-8", "surrogatepass"))
                other = shingles((right[i].as_py() or "").encode("utf-8", "surrogatepass"))
                common = len(hub_set & other)
                good[i] = common and 100 * common >= percent * (len(hub_set) + len(other) - common)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])
    return run


def _print_task(size: int):
    """Per text the number of its shingles and the distinct low 16 bits of their hashes; no prints of more than ``DEEP``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in text_blocks(batch.column(1)):
                row, h = shingle_sets(data, offsets, size)
                number, first = counts_of(row, end - begin)
                low = (h & np.uint64(0xFFFF)).astype("<u2")
                prints = [np.unique(low[a:b]).tobytes() if b - a <= DEEP else None for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(number), pa.array(prints, pa.binary())], ["k", "n", "prints"])
    return run


def _printed_alike(percent: int):
    """Pairs that their prints allow: at most as many shingles are common as prints, and those that fell together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, pa_, pb = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = np.ones(batch.num_rows, bool)
            for i in range(batch.num_rows):
                if pa_[i] is not None and pb[i] is not None:
                    x, y = np.frombuffer(pa_[i], "<u2"), np.frombuffer(pb[i], "<u2")
                    most = len(np.intersect1d(x, y, assume_unique=True)) + min(na[i] - len(x), nb[i] - len(y))
                    keep[i] = most * (100 + percent) >= percent * (na[i] + nb[i])
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])
    return run


#: Spark's own Bloom filters go before a join of any input, not only of 10 GB, if the keys are a table of up to 1 GB.
FILTERED = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1m",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


def _texts_of(texts: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Texts whose k is among ``keys``, as a table.

    All others stop at a Bloom filter in the task that reads them (a filter of the counted keys is
    what Spark asks for to make one), so the exchange moves the texts of these keys and few more.
    """
    counted = written(keys.groupBy("k").agg(F.count("*").alias("times")), f"{name}-keys")
    return written(texts.join(counted.filter("times > 0").select("k"), "k", "left_semi"), name, **FILTERED)


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among candidate pairs (a, b): union-sketch estimate first, prints of whole sets next, full sets then."""
    sketch = classes.select("cls", "n", "sketch")
    known = pairs.join(sketch.withColumnsRenamed({"cls": "a", "n": "na", "sketch": "sa"}), "a").join(
        sketch.withColumnsRenamed({"cls": "b", "n": "nb", "sketch": "sb"}), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    # whole sets are exact; of truncated ones the least number is asked that any link reaches
    whole = F.greatest("na", "nb") <= SKETCH
    likely = F.when(whole, 100 * common >= percent * F.size(F.array_union("sa", "sb"))).otherwise(
        common >= F.least(F.lit(least_common(SKETCH, percent)), F.size(union) / 3))
    likely_pairs = written(known.filter(likely).select("a", "b"), "likely-pairs")
    ends = lambda df: df.select(F.col("a").alias("k")).unionByName(df.select(F.col("b").alias("k")))
    bodies = _texts_of(texts, ends(likely_pairs), "pair-texts")
    # two bytes a shingle tell most pairs that the sketches cannot; only the others fetch both texts
    prints = written(bodies.mapInArrow(_print_task(size), "k long, n long, prints binary"), "prints")
    printed = likely_pairs.join(prints.withColumnsRenamed({"k": "b", "n": "nb", "prints": "pb"}), "b").join(
        prints.withColumnsRenamed({"k": "a", "n": "na", "prints": "pa"}), "a").select("a", "b", "na", "nb", "pa", "pb")
    likely_pairs = written(printed.mapInArrow(_printed_alike(percent), "a long, b long").distinct(), "printed-pairs")
    bodies = bodies.join(ends(likely_pairs).distinct(), "k", "left_semi")
    both = likely_pairs.join(bodies.withColumnsRenamed({"k": "b", "text": "tb"}), "b").join(
        bodies.withColumnsRenamed({"k": "a", "text": "ta"}), "a")
    ordered = both.select("a", "b", "ta", "tb").sortWithinPartitions("a")
    return written(ordered.mapInArrow(_verify_task(size, percent), "a long, b long").distinct(), "links")


def _least_shared(n: F.Column, k: int, percent: int) -> F.Column:
    """Common values that any link of a set of ``n`` shingles leaves in both sketches, whole or truncated."""
    p = percent / 100
    return F.greatest(F.lit(1), F.when(n > k, least_common(k, percent)).otherwise(
        F.least(F.ceil(n * percent / 100), F.floor(k - n * ((1 - p) / p))))).cast("int")


def _with_masks(sets: DataFrame) -> DataFrame:
    """Bit masks of the sketches, and in how many values they fall short of them (``lost``)."""
    def mask(w: int) -> F.Column:
        bit = lambda v: F.when(F.shiftright(v, 6).bitwiseAND(F.lit(3)) == w, F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(F.lit(63)).cast("int"))).otherwise(0)
        return F.aggregate("sketch", F.lit(0).cast("long"), lambda all_bits, v: all_bits.bitwiseOR(bit(v)))
    masked = sets.select("cls", F.size("sketch").alias("size"), *[mask(w).alias(m) for w, m in enumerate(MASKS)])
    return masked.withColumn("lost", F.col("size") - sum(F.bit_count(m) for m in MASKS)).drop("size")


def _masks_allow(own: str, other: str, k: int, percent: int) -> F.Column:
    """The pair's masks share as many bits as its link would, for columns with these suffixes."""
    met = sum(F.bit_count(F.col(m + own).bitwiseAND(F.col(m + other))) for m in MASKS)
    need = F.greatest(_least_shared(F.col("na"), k, percent), _least_shared(F.col("nb"), k, percent))
    return met >= need - F.least("lost" + own, "lost" + other)


def _can_link(percent: int, k: int) -> F.Column:
    """What sizes and shared values allow: (na, sa) and (nb, sb) of a pair."""
    fit = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    # values that a whole set shares with no other bound every intersection
    enough = F.least("sa", "sb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return fit & ((F.greatest("na", "nb") > k) | enough)


def _lists(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Inverted lists (v, cls, n, s, w, masks of sketches that are not deep) of the rarest retained values of each class (cls, n, sketch).

    s counts the retained values that other classes share; w tells how central a class is: the
    text that many others were made from shares all its values.
    """
    values = classes.select("cls", "n", F.explode("sketch").alias("v"))
    frequency = values.groupBy("v").agg(F.count("*").alias("f")).filter("f > 1")
    size, common = F.least(F.col("n"), F.lit(k)), _least_shared(F.col("n"), k, percent)
    shared = values.join(frequency, "v").groupBy("cls", "n").agg(
        F.sort_array(F.collect_list(F.struct("f", "v"))).alias("vs"), F.round(F.sum(F.log2("f")), 3).alias("w"))
    # values that one class alone retains come first in the order, and their lists hold no pair
    prefix = F.greatest(F.lit(0), size - common + 1 - (size - F.size("vs"))).cast("int")
    masks = ()
    listed = shared.withColumn("s", F.size("vs")).withColumn("vs", F.slice("vs", 1, prefix)).filter(F.size("vs") > 0)
    if k == SKETCH:
        masks = (*MASKS, "lost")
        listed = listed.join(_with_masks(classes), "cls")
    return written(listed.select("cls", "n", "s", "w", *masks, F.explode("vs").alias("e")).select(F.col("e.v").alias("v"), "cls", "n", "s", "w", *masks), "lists")


def _placed(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Lists with the component c of each member under the links so far."""
    known = components(links)
    return written(lists.join(known, F.col("cls") == F.col("node"), "left").select(
        *lists.columns, F.coalesce("component", "cls").alias("c")), "placed-lists")


def _split(placed: DataFrame) -> DataFrame:
    """Lists whose members lie in several components: v, members, the largest component."""
    parts = placed.groupBy("v", "c").agg(F.count("*").alias("m"))
    return parts.groupBy("v").agg(F.sum("m").alias("members"), F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("cs")).filter(
        "cs > 1").select("v", "members", F.col("top.c").alias("major"))


def _hub_pairs(lists: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs of the most central member of each long list with the others."""
    masks = [m for m in (*MASKS, "lost") if m in lists.columns]
    hubs = lists.groupBy("v").agg(F.count("*").alias("m"), F.max(F.struct("w", F.negate("cls").alias("o"), "cls", "n", "s", *masks)).alias("h")).filter(
        F.col("m") > LONG_LIST)
    allowed = _can_link(percent, k) & _masks_allow("_x", "_y", k, percent) if masks else _can_link(percent, k)
    return lists.join(hubs, "v").filter(F.col("cls") != F.col("h.cls")).select(
        F.col("h.cls").alias("x"), F.col("h.n").alias("na"), F.col("h.s").alias("sa"), F.col("cls").alias("y"), F.col("n").alias("nb"), F.col("s").alias("sb"),
        *[F.col(f"h.{m}").alias(f"{m}_x") for m in masks], *[F.col(m).alias(f"{m}_y") for m in masks],
    ).filter(allowed).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _against_hub(lists: DataFrame, deep: DataFrame) -> DataFrame:
    """Members of long lists with a hub of theirs, its size, and how they differ from it.

    ``less`` are the hub's values that the member has not, ``more`` those that it adds; two
    members of one hub have their exact intersection by these.  Members that differ in more than
    ``DIFFERENCES`` values have no row.  Both sets must be whole.
    """
    hubs = lists.groupBy("v").agg(F.count("*").alias("m"), F.max(F.struct("w", F.negate("cls").alias("o"), "cls", "n")).alias("h")).filter(
        (F.col("m") > LONG_LIST) & (F.col("h.n") <= DEEP))
    chosen = lists.filter(F.col("n") <= DEEP).join(hubs, "v").groupBy("cls").agg(F.max("h").alias("h")).select(
        "cls", F.col("h.cls").alias("hub"), F.col("h.n").alias("hub_n"))
    sets = deep.select("cls", "sketch")
    return written(chosen.join(sets, "cls").join(sets.withColumnsRenamed({"cls": "hub", "sketch": "hub_sketch"}), "hub").select(
        "cls", "hub", "hub_n", F.array_except("hub_sketch", "sketch").alias("less"), F.array_except("sketch", "hub_sketch").alias("more"),
    ).filter(F.size("less") + F.size("more") <= DIFFERENCES), "hub-members")


def _cross_pairs(open_lists: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs of members outside a list's largest component with the members of other components.

    Lists may carry a hub and the differences from it (see ``_against_hub``); pairs of one hub
    are then made only if their intersection suffices.
    """
    met = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("major")) | (F.col("x") < F.col("y"))) & _can_link(percent, k)
    own, other = {"cls": "x", "n": "na", "s": "sa", "c": "cx", "v": "vx"}, {"cls": "y", "n": "nb", "s": "sb", "c": "cy"}
    if "lost" in open_lists.columns:
        own, other = own | {m: f"{m}_x" for m in (*MASKS, "lost")}, other | {m: f"{m}_y" for m in (*MASKS, "lost")}
        met = met & _masks_allow("_x", "_y", k, percent)
    if "hub" in open_lists.columns:
        own, other = own | {"hub": "hub_x", "less": "less_x", "more": "more_x"}, other | {"hub": "hub_y", "hub_n": "hub_n", "less": "less_y", "more": "more_y"}
        least = F.col("hub_n") - F.greatest(F.size("less_x"), F.size("less_y")) + F.least(F.size("more_x"), F.size("more_y"))
        exact = F.col("hub_n") - F.size("less_x") - F.size("less_y") + F.size(F.array_intersect("less_x", "less_y")) + F.size(
            F.array_intersect("more_x", "more_y"))
        enough = [x * (100 + percent) >= (F.col("na") + F.col("nb")) * percent for x in (least, exact)]
        apart = F.col("hub_x").isNull() | F.col("hub_y").isNull() | (F.col("hub_x") != F.col("hub_y"))
        met = met & (apart | (enough[0] & enough[1]))
    minor = open_lists.filter("c <> major").select(*own).withColumnsRenamed(own)
    rest = open_lists.select("v", "major", *other).withColumnsRenamed(other)
    return minor.join(rest, (F.col("vx") == F.col("v")) & met).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Links are pairs of documents with 100 * intersection >= ``percent`` * union of their sets
    of ``shingle`` consecutive words (ASCII letters lowered); shorter texts are one shingle.
    Null, empty and blank texts have no shingle and are linked with nothing.  component_id is
    the least doc_id reachable.  Rows with one id count as one document where ids matter:
    each gets its row.  A null id is linked by its text; component_id is null only if all ids
    of the component are, and such a row is kept.  Other columns are ignored; an empty table
    gives no rows.  Very long texts are shingled whole.
    """
    return _grouped(docs, shingle, percent, id_col, text_col, F.lit(None)).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, sha: F.Column) -> DataFrame:
    """One row per document: doc_id, sha, n, digest, component_id, component (its least key; null without a shingle)."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("k"), text.alias("text"))
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("k"), sha.cast("string").alias("sha")).alias("k"), text.alias("text"))
    sketched = written(rows.mapInArrow(_sketch_task(shingle, SKETCH), SKETCHED).select(
        F.col("k.id").alias("doc_id"), F.col("k.k").alias("k"), F.col("k.sha").alias("sha"), "n", "digest", "sketch"), "sketches")
    # equal sets are one class, named by its least key
    members = sketched.filter("digest is not null").groupBy("digest").agg(
        F.min("k").alias("cls"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(members, "classes")

    lists = _lists(classes, SKETCH, percent)
    links = _verified(_hub_pairs(lists, percent, SKETCH), classes, texts, shingle, percent)
    placed = _placed(lists, links)
    open_lists = placed.join(_split(placed), "v")
    short = _cross_pairs(open_lists.filter(F.col("members") <= LONG_LIST), percent, SKETCH)
    links = links.unionByName(_verified(short, classes, texts, shingle, percent))

    # long lists that one hub does not hold together: their members are listed again, by deep sketches
    again = open_lists.filter(F.col("members") > LONG_LIST).select(F.col("cls").alias("k"))
    deep_texts = _texts_of(texts, again, "deep-texts").select(F.struct(F.col("k").alias("id"), "k", F.lit(None).cast("string").alias("sha")).alias("k"), "text")
    deep = written(deep_texts.mapInArrow(_sketch_task(shingle, DEEP), SKETCHED).filter("n > 0").groupBy(F.col("k.k").alias("cls")).agg(
        F.max(F.struct("n", "sketch")).alias("e")).select("cls", "e.*"), "deep-sketches")
    deep_lists = _lists(deep, DEEP, percent)
    links = links.unionByName(_verified(_hub_pairs(deep_lists, percent, DEEP), classes, texts, shingle, percent))
    placed = _placed(deep_lists, links).join(_against_hub(deep_lists, deep), "cls", "left")
    links = links.unionByName(_verified(_cross_pairs(placed.join(_split(placed), "v"), percent, DEEP), classes, texts, shingle, percent))
    joined = written(components(links), "components")

    least = joined.join(classes.select("cls", "least"), F.col("node") == F.col("cls")).groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("node", "component", "component_id")
    resolved = classes.select("digest", "cls", "least").join(named, F.col("cls") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "cls").alias("component"),
        F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return sketched.select("doc_id", "sha", "n", "digest").join(resolved, "digest", "left").withColumn(
        "component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Documents with all their columns, one of each group of near duplicates: the one with the least id.

    Rows repeated with that id and text, or with that id and one shingle set, collapse to one.
    Other sets of that id, which are one document with it, stay too, but for one that equals the
    set of a smaller id.  A null id stays only where all ids of the group are null, and then one
    row of the group stays, that with the least SHA-256 of its text.  Texts without a shingle are
    in no group: one row of each id (null is one) and text stays.  Extra columns of any name stay;
    an empty table gives no rows; very long texts are shingled whole.
    """
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    kept = _grouped(docs, shingle, percent, "doc_id", "text", sha).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # what tells survivors apart: the id and its set, the component where ids are null, the text without a set
    apart = F.when(F.col("digest").isNull(), F.col("sha")).when(F.col("doc_id").isNull(), F.col("component").cast("string")).otherwise(F.hex("digest"))
    stay = kept.groupBy("doc_id", apart.alias("apart")).agg(F.min("sha").alias("sha")).select(_row_key(F.col("doc_id"), F.col("sha")).alias("__key"))
    return docs.withColumn("__key", _row_key(F.col("doc_id").cast("long"), sha)).join(
        stay, "__key", "left_semi").dropDuplicates(["__key", "text"]).select(*docs.columns)


def _row_key(doc_id: F.Column, sha: F.Column) -> F.Column:
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), sha)
