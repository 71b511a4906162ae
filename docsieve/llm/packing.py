"""Packing token sequences by bin completion.

Documents are cut into pieces of at most ``capacity`` tokens; full pieces fill a sequence
alone.  The other pieces are dealt by hash over blocks of bounded size, and every block is
packed by branch and bound: take the largest piece that is left, enumerate the fillings
around it that no other filling dominates, and follow them while the waste stays under the
bound that an improvement needs.  Best-fit decreasing gives the first incumbent, and the open
branch is finished by best fit once a block's budget is spent, so a block always ends.
Sequences never span blocks, which costs at most one partly filled sequence a block.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.llm.common import LOWER, prefix_hash, span_hash, text_blocks, words, written

CAPACITY = 4096
BLOCK = 20_000
TRIES = 300_000  # pieces that the search of one block may try
CACHE = 40_000  # parts of words, or half of them, whose tokens a worker keeps; whole words are kept by _Words
WORDS = 1_000_000  # words that a worker keeps in flat arrays before it starts anew

_TOKENIZERS: dict[str, tuple] = {}
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# between a letter or digit and an ASCII sign, either way round; the apostrophe may open a contraction
_CUT = re.compile(r"(?<=[^\W_])(?=[!-&(-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[^\W_])")


class _Memo:
    """Token bytes of parts of texts; the older half is dropped when the newer is full."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.new) >= CACHE:
            self.old, self.new = self.new, {}


def _tokenizer(path: str) -> tuple:
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, number in tokenizer.get_vocab().items():
            ends[number] = token.endswith("</w>")
        _TOKENIZERS[path] = (tokenizer, ends, _Memo(), _Words())
    return _TOKENIZERS[path]


def _encode(texts: list[str], tokenizer: object, ends: np.ndarray) -> list[bytes]:
    """Token bytes of texts without white space, by few calls."""
    out: list[bytes] = [b""] * len(texts)
    # a run of letters is one word to this tokenizer, and every word ends in a token marked so
    plain = [i for i, t in enumerate(texts) if t.isalpha()]
    for first in range(0, len(plain), 2000):
        part = plain[first: first + 2000]
        ids = np.array(tokenizer.encode(" ".join([texts[i] for i in part]), add_special_tokens=False).ids, "<u4")
        edge = (np.flatnonzero(ends[ids]) + 1).tolist()
        if len(edge) != len(part) or edge[-1] != len(ids):
            plain = []
            break
        raw = ids.tobytes()
        for i, a, b in zip(part, [0, *edge], edge):
            out[i] = raw[4 * a: 4 * b]
    done = set(plain)
    for i, text in enumerate(texts):
        if i not in done:
            out[i] = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return out


def chunk_tokens(chunks: list[bytes], path: str) -> list[bytes]:
    """Token ids, as little-endian unsigned 32-bit numbers, of distinct texts without white space.

    A run of letters never joins a sign, so both are encoded on their own; parts met before come
    from a bounded memo.
    """
    tokenizer, ends, memo, _ = _tokenizer(path)
    memo.turn()
    new, old = memo.new, memo.old
    split: list[list[str]] = []
    lacking: dict[str, None] = {}
    for chunk in chunks:
        text = chunk.decode("utf-8", "surrogatepass")
        parts = [text] if text.isalpha() or "<|" in text else _CUT.split(text)
        for part in parts:
            if part not in new:
                tokens = old.get(part)
                if tokens is None:
                    lacking[part] = None
                else:
                    new[part] = tokens
        split.append(parts)
    unseen = list(lacking)
    new.update(zip(unseen, _encode(unseen, tokenizer, ends)))
    return [new[parts[0]] if len(parts) == 1 else b"".join([new[p] for p in parts]) for parts in split]


def token_bytes(raws: list[bytes], path: str) -> list[bytes]:
    """Token ids of texts, one by one.

    The tokenizer drops white space and lowers case, so a text is encoded in chunks between
    spaces, ASCII letters lowered first.  Texts that may hold a special token keep their case.
    """
    split = [raw.split() if b"<|" in raw else raw.translate(_LOWER).split() for raw in raws]
    unseen = list(set().union(*split))
    known = dict(zip(unseen, chunk_tokens(unseen, path)))
    return [b"".join(map(known.__getitem__, chunks)) for chunks in split]


class _Words:
    """Token ids of the words met so far, found by hash and held against their bytes.

    All as flat arrays, so a run of texts is looked up and put together without a step per word:
    its distinct words, their tokens, then the tokens of all words in order.
    """

    def __init__(self) -> None:
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and where their word lies
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, "<u4")
        self.byte_ends, self.id_ends = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def find(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of words (distinct ``hashes``); -1 for those not held, or held with other bytes."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        place = np.where(self.hashes[at] == hashes, self.places[at], -1)
        held = np.flatnonzero(place >= 0)
        first, last = self.byte_ends[place[held]], self.byte_ends[place[held] + 1]
        place[held[~_same_bytes(data, start[held], end[held], self.bytes, first, last)]] = -1
        return place

    def add(self, hashes: np.ndarray, words: list[bytes], ids: list[bytes]) -> np.ndarray:
        """Hold new words; their places."""
        if len(self.places) > WORDS:
            self.__init__()
        new = np.arange(len(words)) + len(self.byte_ends) - 1
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
        self.byte_ends = np.concatenate([self.byte_ends, self.byte_ends[-1] + np.cumsum([len(w) for w in words])])
        self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum([len(i) // 4 for i in ids])])
        # a hash held with other bytes keeps its place; the new word is only put together now
        at = np.searchsorted(self.hashes, hashes)
        fresh = np.append(self.hashes, np.uint64(0))[at] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        fresh |= at == len(self.hashes)
        at = at[fresh]
        self.hashes, self.places = np.insert(self.hashes, at, hashes[fresh]), np.insert(self.places, at, new[fresh])
        return new


def _same_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Which spans of ``a`` equal their spans of ``b``."""
    length = a_end - a_start
    same = length == b_end - b_start
    length = np.where(same, length, 0)
    before = np.cumsum(length) - length
    step = np.arange(int(length.sum())) - np.repeat(before, length)
    differ = a[step + np.repeat(a_start, length)] != b[step + np.repeat(b_start, length)]
    wrong = np.bincount(np.repeat(np.arange(len(length)), length)[differ], minlength=len(length))
    return same & (wrong == 0)


def token_runs(data: np.ndarray, offsets: np.ndarray, path: str) -> list[bytes]:
    """Token ids of a run of texts (see ``text_blocks``), as ``token_bytes`` gives them one by one."""
    known, n = _tokenizer(path)[3], len(offsets) - 1
    lower = LOWER[data]
    start, end, row = words(lower, offsets)
    marked = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) else np.zeros(0, np.int64)
    out: list[bytes] = [b""] * n
    if len(start):
        hashes, first, of = np.unique(span_hash(prefix_hash(lower), start, end), return_index=True, return_inverse=True)
        # every word is held against the one that stands for its hash
        alike = _same_bytes(lower, start, end, lower, start[first][of], end[first][of])
        place = known.find(hashes, lower, start[first], end[first])
        lacking = np.flatnonzero(place < 0)
        if len(lacking) and len(known.places) > WORDS:  # about to start anew
            place, lacking = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        if len(lacking):
            own = [lower[a:b].tobytes() for a, b in zip(start[first[lacking]].tolist(), end[first[lacking]].tolist())]
            place[lacking] = known.add(hashes[lacking], own, chunk_tokens(own, path))
        own_place = place[of]
        count = known.id_ends[own_place + 1] - known.id_ends[own_place]
        after = np.cumsum(count)
        index = np.arange(int(after[-1])) - np.repeat(after - count - known.id_ends[own_place], count)
        ids = known.ids[index].tobytes()
        ends = np.concatenate([[0], after])[np.searchsorted(row, np.arange(n + 1))].tolist()
        out = [ids[4 * a: 4 * b] for a, b in zip(ends[:-1], ends[1:])]
        strange = set(row[~alike].tolist())
    else:
        strange = set()
    # texts that may hold a special token, and those with a word of another's hash, on their own
    strange |= set((np.searchsorted(offsets, marked, "right") - 1).tolist())
    for i in sorted(strange):
        out[i] = token_bytes([data[offsets[i]: offsets[i + 1]].tobytes()], path)[0]
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for first, last, data, offsets in text_blocks(batch.column(1)):
                for doc_id, found in zip(ids[first:last], token_runs(data, offsets, path)):
                    tokens = found + end
                    for piece, at in enumerate(range(0, len(tokens), 4 * capacity)):
                        part = tokens[at: at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


# ---- one block -------------------------------------------------------------------------

class _Stock:
    """Pieces that are left, as sorted distinct lengths with counts."""

    def __init__(self, lengths: list[int]) -> None:
        self.count: dict[int, int] = {}
        for x in lengths:
            self.count[x] = self.count.get(x, 0) + 1
        self.sizes = sorted(self.count)

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            del self.count[x]
            self.sizes.pop(bisect.bisect_left(self.sizes, x))

    def give(self, x: int) -> None:
        if x not in self.count:
            self.count[x] = 0
            bisect.insort(self.sizes, x)
        self.count[x] += 1

    def largest_up_to(self, room: int) -> int | None:
        at = bisect.bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else None


def _best_fit(stock: _Stock, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the fullest open sequence that still has room takes the piece."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for x in reversed(stock.sizes):
        for _ in range(stock.count[x]):
            at = bisect.bisect_left(rooms, (x, -1))
            if at < len(rooms):
                room, b = rooms.pop(at)
            else:
                room, b = capacity, len(bins)
                bins.append([])
            bins[b].append(x)
            if room > x:
                bisect.insort(rooms, (room - x, b))
    return bins


def _fillings(stock: _Stock, room: int, waste: int, budget: list[int], width: int = 6, leaves: int = 32) -> list[list[int]]:
    """Undominated fillings of ``room`` with at most ``waste`` left, best filled first.

    A filling that leaves room for another piece is dominated by the one that adds it, so only
    maximal ones count; pieces come in falling order, the closest fit first, then the next
    two smaller sizes.  ``budget`` counts the pieces tried.
    """
    found: list[tuple[int, list[int]]] = []
    chosen: list[int] = []
    tried: list[int] = []
    left, x, seen = room, stock.largest_up_to(room), 0
    while True:
        while x is not None and budget[0] > 0:
            stock.take(x)
            chosen.append(x)
            tried.append(1)
            left, budget[0] = left - x, budget[0] - 1
            x = stock.largest_up_to(min(left, x))
        seen += 1
        if left <= waste and stock.largest_up_to(left) is None:
            found.append((left, list(chosen)))
        if len(found) >= width or seen >= leaves or budget[0] <= 0:
            break
        x = None
        while chosen and x is None:
            last, times = chosen.pop(), tried.pop()
            stock.give(last)
            left += last
            at = bisect.bisect_left(stock.sizes, last)
            if times < 3 and at:
                x = stock.sizes[at - 1]
        if x is None:
            break
        stock.take(x)
        chosen.append(x)
        tried.append(times + 1)
        left, budget[0] = left - x, budget[0] - 1
        x = stock.largest_up_to(min(left, x))
    for x in chosen:
        stock.give(x)
    return [f for _, f in sorted(found, key=lambda item: (item[0], len(item[1])))]


def pack_block(lengths: list[int], capacity: int = CAPACITY, tries: int = TRIES) -> list[list[int]]:
    """Sequences (lists of lengths) for one block; as few as the search finds.

    Fewer than total / capacity are impossible, and the search stops there.  After ``tries``
    pieces tried, the open branch is finished by best fit and the best packing met counts.
    """
    total = sum(lengths)
    lower = -(-total // capacity)
    best = _best_fit(_Stock(lengths), capacity)
    stock, budget = _Stock(lengths), [tries]
    done: list[list[int]] = []
    levels: list[list[list[int]]] = []  # fillings that each open level has not tried yet
    wasted = 0

    def branch() -> list[list[int]]:
        # a better packing has len(best) - 1 sequences, so this much may stay empty in all
        slack = (len(best) - 1) * capacity - total - wasted
        if slack < 0:
            return []
        top = stock.sizes[-1]
        stock.take(top)
        options = _fillings(stock, capacity - top, slack, budget)
        stock.give(top)
        return [[top, *f] for f in reversed(options)]

    if len(best) > lower:
        levels.append(branch())
    while levels and len(best) > lower:
        if budget[0] <= 0:
            rest = [*done, *_best_fit(stock, capacity)]
            best = min(best, rest, key=len)
            break
        if not levels[-1]:
            levels.pop()
            if done:
                undone = done.pop()
                wasted -= capacity - sum(undone)
                for x in undone:
                    stock.give(x)
            continue
        chosen = levels[-1].pop()
        for x in chosen:
            stock.take(x)
        done.append(chosen)
        wasted += capacity - sum(chosen)
        if stock.sizes:
            levels.append(branch())
        else:
            best = min(best, [list(b) for b in done], key=len)
            levels.append([])
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, tries: int = TRIES) -> DataFrame:
    """Add sequence_id and offset to pieces; all columns stay.

    Blocks hold about ``block`` pieces each, whatever the number of pieces.
    """
    pieces = pieces.withColumn("__h", F.xxhash64("doc_id", "piece", "start", "ids_crc32"))
    blocks = max(1, -(-pieces.filter(F.col("length") < capacity).count() // block))
    dealt = pieces.withColumn("__block", F.when(F.col("length") < capacity, F.pmod("__h", F.lit(blocks))).otherwise(-1 - F.pmod(F.col("__h"), F.lit(4 * blocks))))
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block: pack each block when its last row has come."""
        held, number = [], None

        def flush() -> pa.RecordBatch | None:
            if not held:
                return None
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = table.column("length").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            if number < 0:  # full pieces, one a sequence
                bins = [[int(x)] for x in lengths]
            else:
                bins = pack_block(lengths.tolist(), capacity, tries)
            rows_of: dict[int, list[int]] = {}
            for row, x in enumerate(lengths.tolist()):
                rows_of.setdefault(x, []).append(row)
            for i, content in enumerate(bins):
                at = 0
                for x in content:
                    row = rows_of[x].pop()
                    sequence[row], offset[row] = i, at
                    at += x
            ids = ((number + (4 * blocks + 1)) << 32) + sequence
            held.clear()
            table = table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))
            return table.select([*[n for n in names if n != "__h"], "sequence_id", "offset"]).to_batches()[0]

        for batch in batches:
            numbers = batch.column(batch.schema.get_field_index("__block")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for first, end in zip(edges[:-1], edges[1:]):
                if end > first and numbers[first] != number:
                    out = flush()
                    if out is not None:
                        yield out
                    number = int(numbers[first])
                if end > first:
                    held.append(batch.slice(first, end - first))
        out = flush()
        if out is not None:
            yield out

    schema = T.StructType([*pieces.drop("__h").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.repartition("__block").sortWithinPartitions("__block", "__h").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, block: int = BLOCK, tries: int = TRIES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids, then ``end_id``: a null or empty text is one token.  Rows
    repeated with one id are packed each; null ids stay null.  Very long texts are tokenized
    whole and cut into pieces of ``capacity``.  Other columns are ignored.  An empty table gives
    no rows.
    """
    return pack(written(tokenize(docs, path, capacity, end_id), "pieces"), capacity, block, tries)
