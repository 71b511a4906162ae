"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks in page order.  Every block becomes a vector: its hashed tag
path, its hashed words and a few figures.  A bidirectional LSTM (numpy) reads the sequence of
the whole page, so each block is labelled knowing everything before and after it.

The labeller is trained here, in one task, on a bounded sample of pages whose own markup
names the article and its surroundings, and on pages composed from their blocks in other
layouts (no article element, comments, notices, forms, sidebars), for which the labels are
known by construction.
"""

from __future__ import annotations

import bisect
import html as entities
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import LOWER, mix, one_text, prefix_hash, span_hash, words

PATH_DIM, WORD_DIM, FIGURES = 64, 24, 6
DIM = PATH_DIM + WORD_DIM + FIGURES
HIDDEN = 20
TRAIN_PAGES = 300  # bound of the training sample
COMPOSED = 1000  # least number of composed training pages
EPOCHS, RATE, BATCH, SEED = 10, 0.01, 16, 5
MAX_TRAIN_BLOCKS = 400  # longer pages are not learned from; every page is extracted whole

# elements without visible text; all but svg ignore a slash at the end of their tag
_RAW = re.compile(r"(script|style|template|noscript|svg|iframe|object|canvas|textarea|select|title)\b", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_SIGNS = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr img br button".split())
# an opening tag of the key closes an open element of the value, if no container lies between
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTAINERS = frozenset("ul ol dl table body article section div nav aside header footer main form".split())
# elements that leave an open head open; basefont and bgsound have no end tag
_IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
_HEAD_TOP = frozenset("head basefont bgsound".split())
_PIECES = re.compile(r"[a-z]+")

Block = tuple["Path | tuple[str, ...]", str, int]  # tag path, text, characters inside links


class Path:
    """Names of the open elements of a block, outermost first, and their vector.

    The vector is kept up to date while elements open and close, so a block costs the same at
    any depth; the names are put together only where they are asked for.
    """

    __slots__ = ("node", "vector", "hidden")

    def __init__(self, node: tuple, vector: bytes, hidden: bool) -> None:
        self.node, self.vector, self.hidden = node, vector, hidden

    @property
    def names(self) -> tuple[str, ...]:
        parts, node = [], self.node
        while node is not None:
            parts.append(node[1])
            node = node[0]
        return tuple(n for names in reversed(parts) for n in names)


@lru_cache(maxsize=20_000)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """Path names of an element: its tag, then class, id and role words."""
    out = [tag]
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        out += [f".{piece}" for piece in _PIECES.findall((a or b or c).lower())]
    return tuple(out)


def _tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Markup in page order: (start, end, tag or None for what has no element, end tag, attributes).

    Comments, declarations and elements without visible text are one piece each, to the end of
    the page if they are not closed.  A tag without its ``>`` is text.  Linear in the page: once a
    tag was found open, the ends of all later ones are read off a table made in one pass.
    """
    ends: dict[int, int] | None = None
    signs: list[int] = []
    n, last, at = len(page), page.rfind(">"), page.find("<")

    def table() -> None:
        """For each ``>`` or quote outside quotes: where a tag that reaches it there ends."""
        nonlocal ends
        ends, upcoming = {}, {}
        for found in reversed(list(_SIGNS.finditer(page))):
            i, sign = found.start(), found[0]
            if sign == ">":
                ends[i] = i
            else:
                close = upcoming.get(sign)
                beyond = None if close is None else following.get(close)
                ends[i] = -1 if beyond is None else ends[beyond]
                upcoming[sign] = i
            following[i] = signs[-1] if signs else None
            signs.append(i)
        signs.reverse()

    following: dict[int, int | None] = {}

    def tag_at(at: int) -> tuple[int, str, bool, str] | None:
        if ends is None:
            found = _TAG.match(page, at)
            if found:
                return found.end(), found[2], bool(found[1]), found[3]
            if not _TAG_NAME.match(page, at):
                return None
            table()
        named = _TAG_NAME.match(page, at)
        k = bisect.bisect_left(signs, named.end()) if named else len(signs)
        end = ends[signs[k]] if k < len(signs) else -1
        return None if end < 0 else (end + 1, named[2], bool(named[1]), page[named.end(): end])

    while 0 <= at:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at + 9)
            end = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            end = n if end < 0 else end + 1
        else:
            found = tag_at(at) if at < last else None
            if found is None:
                at = page.find("<", at + 1)
                continue
            end, tag, closing, attributes = found
            raw = None if closing else _RAW.match(tag)
            if raw is None:
                yield at, end, tag.lower(), closing, attributes
                at = page.find("<", end)
                continue
            if not (raw[1].lower() == "svg" and attributes.endswith("/")):
                close = _closing(raw[1].lower()).search(page, end)
                end = n if close is None else close.end()
        yield at, end, None, False, ""
        at = page.find("<", end)


@lru_cache(maxsize=None)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*+>", re.I)


class _Open:
    """The open elements of a page, with all that blocks and end tags ask of them, each in constant time."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple]] = []
        self.places: dict[str, list[int]] = {}  # of each tag, ascending
        self.kinds: dict[str, list[int]] = {"block": [], "container": [], "body": []}
        self.count: dict[str, int] = {}
        self.vector = [0.0] * PATH_DIM
        self.known: dict[int, Path] = {}

    def _add(self, name: str, by: int) -> None:
        before = self.count.get(name, 0)
        self.count[name] = before + by
        if (by > 0 and before == 0) or (by < 0 and before == 1):
            cell, sign = _cell(name)
            self.vector[cell] += sign * by

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        at = len(self.stack)
        self.stack.append((tag, (self.stack[-1][1] if self.stack else None, names)))
        self.places.setdefault(tag, []).append(at)
        for kind, belongs in (("block", tag not in _INLINE), ("container", tag in _CONTAINERS), ("body", tag not in _HEAD_TOP)):
            if belongs:
                self.kinds[kind].append(at)
        for name in names:
            self._add(name, 1)

    def cut(self, at: int) -> None:
        """Close every element from place ``at`` on."""
        while len(self.stack) > at:
            tag, (_, names) = self.stack.pop()
            self.places[tag].pop()
            for places in self.kinds.values():
                if places and places[-1] == len(self.stack):
                    places.pop()
            for name in names:
                self._add(name, -1)
            self.known.pop(len(self.stack), None)

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def last_of(self, kind: str) -> int:
        return self.kinds[kind][-1] if self.kinds[kind] else -1

    def path(self) -> Path:
        at = len(self.stack) - 1
        if at not in self.known:
            node = self.stack[-1][1] if self.stack else None
            names = node[1] if node else ()
            if node and len(names) < 2:
                names = (*(node[0][1][-1:] if node[0] else ()), *names)
            vector = array("f", self.vector)
            cell, sign = _cell("/".join(names[-2:]))
            vector[cell] += sign
            self.known[at] = Path(node, vector.tobytes(), self.last("head") >= 0)
        return self.known[at]


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, white space collapsed, character references decoded.

    Linear in the page, whatever is left open or nested in it.
    """
    out: list[Block] = []
    text: list[str] = []
    elements = _Open()
    linked, path = 0, elements.path()

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append((path, whole, linked))
            text.clear()
        linked = 0

    def leave_head() -> None:
        """An open head ends, with or without its end tag, where anything of the body begins."""
        beyond = elements.last_of("body")
        if elements.last("head") > beyond:
            elements.cut(beyond + 1)

    def add(raw: str) -> None:
        nonlocal linked, path
        if not raw:
            return
        raw = entities.unescape(raw) if "&" in raw else raw
        if not text:
            if raw.isspace():
                return
            leave_head()
            path = elements.path()
        text.append(raw)
        if elements.last("a") >= 0:
            linked += len(raw.strip())

    at = 0
    for start, end, tag, closing, attributes in _tags(page):
        add(page[at:start])
        at = end
        if tag is None:
            continue
        if tag not in _INLINE:
            flush()
        elif tag == "br" and text:
            text.append(" ")
        if closing:
            place = elements.last(tag)
            if place >= 0 and not (tag in _INLINE and elements.last_of("block") > place):
                elements.cut(place)
        else:
            if tag not in _IN_HEAD:
                leave_head()
            if tag not in _INLINE or tag in _CLOSES:
                place = max(elements.last(t) for t in ("p", *_CLOSES.get(tag, ())))
                if place > elements.last_of("container"):
                    elements.cut(place)
            if tag not in _VOID and not attributes.rstrip().endswith("/"):
                elements.push(tag, _names(tag, attributes))
    add(page[at:])
    flush()
    return out


@lru_cache(maxsize=100_000)
def _cell(name: str) -> tuple[int, float]:
    h = zlib.crc32(name.encode("utf-8", "surrogatepass"))
    return h % PATH_DIM, 1.0 if h & 1024 else -1.0


@lru_cache(maxsize=50_000)
def _path_vector(path: tuple[str, ...]) -> bytes:
    """Signed hashed counts of the path's names, and of the innermost two as a pair."""
    out = array("f", [0.0] * PATH_DIM)
    for name in [*dict.fromkeys(path), "/".join(path[-2:])]:
        cell, sign = _cell(name)
        out[cell] += sign
    return out.tobytes()


def vectors(page: list[Block]) -> np.ndarray:
    """One row per block; a head of the document (title and the like) never counts as visible."""
    n = len(page)
    out = np.zeros((n, DIM), np.float32)
    out[:, :PATH_DIM] = np.frombuffer(b"".join([p.vector if isinstance(p, Path) else _path_vector(p) for p, _, _ in page]), np.float32).reshape(n, PATH_DIM)
    raw = [t.encode("utf-8", "surrogatepass") for _, t, _ in page]
    data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    start, end, row = words(data, offsets)
    number = np.maximum(np.bincount(row, minlength=n), 1)
    h = mix(span_hash(prefix_hash(data), start, end))
    sign = np.where(h & np.uint64(1), 1.0, -1.0)
    cell = row * WORD_DIM + ((h >> np.uint64(8)) % np.uint64(WORD_DIM)).astype(np.int64)
    out[:, PATH_DIM: PATH_DIM + WORD_DIM] = np.bincount(cell, sign, n * WORD_DIM).reshape(n, WORD_DIM) / np.sqrt(number)[:, None]
    length = np.maximum(np.array([len(t) for _, t, _ in page]), 1)
    base = PATH_DIM + WORD_DIM
    out[:, base] = np.log1p(number) / 4
    out[:, base + 1] = np.minimum(np.array([k for _, _, k in page]) / length, 1)
    out[:, base + 2] = np.log1p(length) / 8
    out[:, base + 3] = [t[-1] in ".!?:;\"'" for _, t, _ in page]
    out[:, base + 4] = (np.arange(n) + 1) / n
    out[:, base + 5] = 1 / (np.arange(n) + 1)
    return out


# ---- the network ------------------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_model(rng: np.random.Generator) -> dict[str, np.ndarray]:
    out = {}
    for side in "fb":
        out[f"w{side}"] = (rng.standard_normal((DIM, 4 * HIDDEN)) / np.sqrt(DIM)).astype(np.float32)
        out[f"u{side}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        out[f"c{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    out["v"] = (rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
    out["d"] = np.zeros(1, np.float32)
    return out


def _run(x: np.ndarray, alive: np.ndarray, w: np.ndarray, u: np.ndarray, c: np.ndarray, keep: list | None) -> np.ndarray:
    """LSTM over time-major input; ``alive`` freezes the state of sequences that have ended."""
    steps, batch, _ = x.shape
    h = s = np.zeros((batch, HIDDEN), np.float32)
    out = np.zeros((steps, batch, HIDDEN), np.float32)
    fed = x @ w + c
    for t in range(steps):
        g = fed[t] + h @ u
        i, f, o = (_sigmoid(g[:, k * HIDDEN: (k + 1) * HIDDEN]) for k in (0, 1, 2))
        a = np.tanh(g[:, 3 * HIDDEN:])
        m = alive[t][:, None]
        new = f * s + i * a
        r = np.tanh(new)
        if keep is not None:
            keep.append((i, f, o, a, s, r, h, m))
        s = np.where(m, new, s)
        h = np.where(m, o * r, h)
        out[t] = h
    return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), DIM), np.float32)
    alive = np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], alive[: len(p), j] = p, True
    return x, alive


def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Reverse each sequence within its own length."""
    t = np.arange(x.shape[0])[:, None]
    index = np.where(t < lengths, lengths - 1 - t, t)
    return np.take_along_axis(x, index.reshape(index.shape + (1,) * (x.ndim - 2)), 0)


def probabilities(pages: list[np.ndarray], model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Share of main text per block, page by page; pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((j for j in range(len(pages)) if len(pages[j])), key=lambda j: len(pages[j]))
    first = 0
    while first < len(order):
        end = first + 1
        while end < len(order) and end - first < 256 and len(pages[order[end]]) * (end + 1 - first) <= 20_000:
            end += 1
        part = [pages[j] for j in order[first:end]]
        x, alive = _padded(part)
        lengths = np.array([len(p) for p in part])
        forward = _run(x, alive, model["wf"], model["uf"], model["cf"], None)
        backward = _flip(_run(_flip(x, lengths), alive, model["wb"], model["ub"], model["cb"], None), lengths)
        p = _sigmoid(np.concatenate([forward, backward], 2) @ model["v"] + model["d"])
        for k, j in enumerate(order[first:end]):
            out[j] = p[: lengths[k], k]
        first = end
    return out


def _gradients(pages: list[np.ndarray], labels: list[np.ndarray], model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    x, alive = _padded(pages)
    lengths = np.array([len(p) for p in pages])
    y = np.zeros(alive.shape, np.float32)
    for j, part in enumerate(labels):
        y[: len(part), j] = part
    kept: dict[str, list] = {"f": [], "b": []}
    flipped = _flip(x, lengths)
    h = {"f": _run(x, alive, model["wf"], model["uf"], model["cf"], kept["f"]),
         "b": _run(flipped, alive, model["wb"], model["ub"], model["cb"], kept["b"])}
    both = np.concatenate([h["f"], _flip(h["b"], lengths)], 2)
    error = (_sigmoid(both @ model["v"] + model["d"]) - y) * alive / alive.sum()
    out = {"v": np.einsum("tb,tbh->h", error, both), "d": np.array([error.sum()])}
    back = error[:, :, None] * model["v"]
    for side, source in (("f", x), ("b", flipped)):
        own = back[:, :, :HIDDEN] if side == "f" else _flip(back[:, :, HIDDEN:], lengths)
        w, u, c = np.zeros_like(model[f"w{side}"]), np.zeros_like(model[f"u{side}"]), np.zeros_like(model[f"c{side}"])
        dh = ds = np.zeros((len(pages), HIDDEN), np.float32)
        for t in range(len(source) - 1, -1, -1):
            i, f, o, a, s, r, before, m = kept[side][t]
            dh = dh + own[t]
            step = np.where(m, dh, 0)
            dn = np.where(m, ds, 0) + step * o * (1 - r * r)
            g = np.concatenate([dn * a * i * (1 - i), dn * s * f * (1 - f), step * r * o * (1 - o), dn * i * (1 - a * a)], 1)
            w += source[t].T @ g
            u += before.T @ g
            c += g.sum(0)
            dh, ds = np.where(m, g @ u_t(model, side), dh), np.where(m, dn * f, ds)
        out[f"w{side}"], out[f"u{side}"], out[f"c{side}"] = w, u, c
    return out


def u_t(model: dict[str, np.ndarray], side: str) -> np.ndarray:
    return model[f"u{side}"].T


def train(pages: list[tuple[list[Block], np.ndarray]]) -> dict[str, np.ndarray]:
    """Adam over shuffled batches; the seed is fixed."""
    rng = np.random.default_rng(SEED)
    model = new_model(rng)
    first = {k: np.zeros_like(v, np.float64) for k, v in model.items()}
    second = {k: np.zeros_like(v, np.float64) for k, v in model.items()}
    inputs = [vectors(p) for p, _ in pages]
    step = 0
    for _ in range(EPOCHS):
        # batches of like length, in random order: a long page makes no short one wait
        order = sorted(rng.permutation(len(pages)), key=lambda j: len(inputs[j]))
        for at in rng.permutation(np.arange(0, len(order), BATCH)):
            chosen = order[at: at + BATCH]
            grads = _gradients([inputs[j] for j in chosen], [pages[j][1] for j in chosen], model)
            step += 1
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] = (model[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


# ---- training pages ---------------------------------------------------------------------

_MAIN = frozenset("article main".split())
_AROUND = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog"}
_AROUND_WORDS = frozenset(
    ".ad .ads .advert .advertisement .sponsor .promo .banner .cookie .notice .consent .alert .newsletter .subscribe .signup .nav .navbar "
    ".menu .breadcrumb .breadcrumbs .header .masthead .footer .sidebar .aside .widget .related .recommended .share .social .comment .comments "
    ".respond .reply .form .login .search .pagination .pager .copyright .tags .meta .popup .modal".split())


def taught(page: list[Block]) -> np.ndarray | None:
    """Labels by the page's own markup, or None where it names no article."""
    labels = np.array([_is_main(p.names) for p, _, _ in page], np.float32)
    return labels if labels.any() else None


def _is_main(names: tuple[str, ...]) -> bool:
    """Inside an article and in nothing around; a header inside the article is its own."""
    inside = max((i for i, name in enumerate(names) if name in _MAIN), default=-1)
    own = [name for i, name in enumerate(names) if not (i > inside and name == "header")]
    return inside >= 0 and not (_AROUND & set(own) or _AROUND_WORDS & set(own))


#: Forms of text in an article: runs of (path, how many blocks, how many words a block).
_FORMS = (
    (("ul li", (2, 7), (1, 14)),), (("ol li", (2, 7), (1, 14)),), (("ul li p", (2, 5), (3, 20)),), (("ul li", (1, 5), (1, 6)), ("ul li ul li", (1, 4), (1, 6)), ("ul li", (1, 3), (1, 6)), ("p", (1, 3), (10, 50))),
    (("pre", (1, 2), (3, 40)),), (("pre code", (1, 2), (2, 40)),), (("div .highlight pre code", (1, 2), (2, 30)),), (("p code", (1, 2), (1, 6)),),
    (("blockquote", (1, 2), (5, 40)),), (("blockquote p", (1, 3), (5, 40)),), (("blockquote p", (1, 2), (5, 30)), ("blockquote cite", (1, 2), (1, 5))),
    (("table tr th", (2, 5), (1, 3)), ("table tr td", (2, 13), (1, 4))), (("table thead tr th", (2, 5), (1, 3)), ("table tbody tr td", (2, 13), (1, 4))),
    (("table caption", (1, 2), (2, 10)), ("table tr td", (2, 13), (1, 4))), (("div table tbody tr td", (2, 9), (1, 6)),), (("table tr td p", (2, 7), (1, 9)),),
    (("figure figcaption", (1, 2), (3, 20)),), (("div .figure p .caption", (1, 2), (3, 20)),), (("dl dt", (1, 2), (1, 4)), ("dl dd", (1, 2), (3, 20)), ("dl dt", (1, 2), (1, 4)), ("dl dd", (1, 2), (3, 20))),
    (("h2", (1, 2), (1, 7)), ("p", (1, 3), (10, 50))), (("section h2", (1, 2), (1, 7)), ("section p", (1, 4), (10, 50))), (("h3", (1, 2), (1, 7)), ("ul li", (2, 6), (1, 9))),
    (("div p", (1, 4), (8, 40)),), (("div", (1, 3), (8, 40)),), (("details summary", (1, 2), (1, 6)), ("details p", (1, 2), (5, 30))), (("address", (1, 2), (3, 12)),),
)


def _composed(page: list[Block], labels: np.ndarray, rng: np.random.Generator, texts: list[str]) -> tuple[list[Block], np.ndarray]:
    """The page's article in another layout, with other surroundings."""
    def pick(options: str) -> tuple[str, ...]:
        choices = options.split("|")
        return tuple(choices[rng.integers(len(choices))].split())

    def words_of(low: int, high: int) -> str:
        source = texts[rng.integers(len(texts))].split()
        n, at = int(rng.integers(low, high)), int(rng.integers(max(1, len(source))))
        return " ".join((source[at:] + source)[:n]) or "x"

    root = ("html", "body")
    out: list[tuple[tuple[str, ...], str, int, int]] = []

    def around(path: tuple[str, ...], number: int, low: int, high: int, link: bool) -> None:
        for _ in range(number):
            text = words_of(low, high)
            out.append((root + path, text, len(text) if link else 0, 0))

    def chance(p: float) -> bool:
        return rng.random() < p

    if chance(0.7):
        around(pick("header|div .header|div .site .header|header .masthead|div .banner") + pick("h1|div .logo a|p|a|h2"), 1, 1, 5, chance(0.5))
    if chance(0.8):
        around(pick("nav ul li a|div .nav ul li a|ul .menu li a|div .navbar a|header nav a|div .breadcrumbs a"), int(rng.integers(2, 9)), 1, 3, True)
    if chance(0.4):
        around(pick("div .ad|div .advert p|aside .ads|div .sponsor p|div .promo|ins .ad"), 1, 2, 25, chance(0.3))
    if chance(0.4):
        around(pick("div .cookie .notice p|div .notice|div .alert p|section .consent p|div .cookie .banner|dialog p"), int(rng.integers(1, 3)), 3, 30, False)
    side = pick("aside|div .sidebar|aside .sidebar|div .widget|div .related")
    if chance(0.25):
        around(side + pick("ul li a|p|h3|section p"), int(rng.integers(1, 5)), 2, 20, chance(0.5))
    if chance(0.4):
        root += pick("div|div .wrap|div .container|div .page div .row|div .layout div .column")
    home = pick("article|article|main|main article|div .content|div .post|div .article .body|div .entry .content|section .story|div|div .main .text|div .page div")
    longer = int(rng.integers(2, 40)) if chance(0.1) else 1  # some articles are very long
    rich, headed = chance(0.6), chance(0.4)

    def inside(path: tuple[str, ...], text: str, linked: int = 0) -> None:
        out.append((root + home + path, text, linked, 1))

    for at, ((path, text, linked), label) in enumerate(list(zip(page, labels)) * longer):
        if len(out) >= MAX_TRAIN_BLOCKS or not label:
            continue
        names = path.names
        cut = max([i for i, name in enumerate(names) if name in _MAIN], default=len(names) - 2) + 1
        if headed and not any(row[3] for row in out):
            # the article's own head: its title, perhaps a line below it
            head = pick("header|header .entry|div .head|hgroup|div .title|header div")
            inside(head + pick("h1|h1|h2"), text, linked)
            if chance(0.6):
                inside(head + pick("p|p .byline|p .lead|div|time|span .author"), words_of(2, 14))
        else:
            inside(names[cut:] or ("p",), text, linked)
        if rich and chance(0.4):
            # other forms of text that articles hold, in runs as they come
            for form in _FORMS[rng.integers(len(_FORMS))]:
                for _ in range(int(rng.integers(*form[1]))):
                    inside(tuple(form[0].split()), words_of(*form[2]))
        if chance(0.1):
            around(home + pick("div .ad|aside|aside p|aside .promo p|div .advert p|div .share a|figure .advert|form .newsletter p|div .sponsor|aside div"), 1, 1, 15, chance(0.3))
    if chance(0.35):
        around(home + pick("div .share a|div .tags a|p .meta|div .meta span"), int(rng.integers(1, 4)), 1, 5, chance(0.6))
    if chance(0.5):
        thread = pick("section .comments|div .comments|div #|ol .comment .list li|div .responses")
        if chance(0.6):
            around(thread[:2] + pick("h2|h3|h4|p .title|div .comments .title"), 1, 1, 4, False)
        around(thread + pick("div .comment p|li .comment p|div .comment .body p|p .comment|article .comment p"), int(rng.integers(1, 7)), 3, 40, False)
    if chance(0.3):
        around(pick("form|div .login form|form .search|form .newsletter|div .signup form") + pick("label|p|button|div|span"), int(rng.integers(1, 4)), 1, 12, False)
    if chance(0.4):
        around(side + pick("ul li a|p|h3|section p"), int(rng.integers(1, 6)), 2, 20, chance(0.5))
    if chance(0.9):
        around(pick("footer|footer p|div .footer p|div .footer ul li a|footer div|div .copyright"), int(rng.integers(1, 4)), 2, 16, chance(0.2))
    return [(p, t, k) for p, t, k, _ in out], np.array([y for *_, y in out], np.float32)


_PLAIN_PAGE = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1><p>First words of it.</p><p>More words of it, and others.</p></article><footer>End</footer></body></html>"


def training_set(pages: list[str]) -> list[tuple[list[Block], np.ndarray]]:
    """Pages taught by their markup, each followed by others composed from it: two, or as many as make ``COMPOSED``."""
    rng = np.random.default_rng(SEED)
    known = []
    for page in [*pages, _PLAIN_PAGE]:
        cut = blocks(page)
        labels = taught(cut) if cut and len(cut) <= MAX_TRAIN_BLOCKS else None
        if labels is not None:
            known.append((cut, labels))
    texts = [t for page, _ in known for _, t, _ in page]
    out = []
    for page, labels in known:
        out.append((page, labels))
        out += [_composed(page, labels, rng, texts) for _ in range(max(2, -(-COMPOSED // len(known))))]
    return out


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages = [p for batch in batches for p in batch.column(0).to_pylist()]
    model = train(training_set(pages))
    names = sorted(model)
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([model[n].tobytes() for n in names], pa.binary())], names=["name", "weights"])


def fit(pages: DataFrame, sample: int = TRAIN_PAGES) -> dict[str, np.ndarray]:
    """Train on at most ``sample`` pages, chosen by a hash of page_id; one task learns from them.

    Of the rows repeated with one page_id, one is learned from: that with the least hash of its html.
    """
    spark = pages.sparkSession
    ids = pages.select(F.col("page_id").cast("long").alias("s_id")).filter("s_id is not null").distinct().orderBy(F.xxhash64("s_id"), "s_id").limit(sample)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    chosen = own.join(F.broadcast(ids), F.col("page_id") == F.col("s_id")).groupBy("page_id").agg(one_text("html"))
    plain = spark.createDataFrame([(None, "")], "page_id long, html string")
    rows = chosen.unionByName(plain).repartition(1).sortWithinPartitions("page_id", "html").select("html").mapInArrow(
        _train_task, "name string, weights binary").collect()
    shapes = {k: v.shape for k, v in new_model(np.random.default_rng(0)).items()}
    return {r["name"]: np.frombuffer(r["weights"], np.float32).reshape(shapes[r["name"]]) for r in rows}


def main_text(pages: list[str], model: dict[str, np.ndarray]) -> list[str]:
    cut = [[b for b in blocks(p) if not b[0].hidden] for p in pages]
    chances = probabilities([vectors(c) if c else np.zeros((0, DIM), np.float32) for c in cut], model)
    return ["\n".join([t for (_, t, _), y in zip(c, p) if y >= 0.5]) for c, p in zip(cut, chances)]


def extract(pages: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty html give the empty text, as do pages without main text.  Rows repeated
    with one page_id are extracted each; null ids and urls stay null.  Very long, deep or broken
    pages are read whole in linear time.  Other columns are
    ignored.  An empty table gives no rows.  The model (about 90 kB, its size fixed) is sent
    to the tasks.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages) if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                texts = main_text([h or "" for h in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
