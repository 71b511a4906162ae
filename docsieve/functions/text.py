"""Text normalisation as native Column expressions (no Python per row)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions import dims

# White space as Unicode text tools understand it, wider than SQL TRIM's single blank.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
_OTHER_LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# ---- Fixed values: the chat markers before a model's own words ---------------------------
ASSISTANT_MARKERS = ("Assistant:", "<|im_start|>assistant")

# ---- Fixed values: characters kept when comparing (letters, digits, _ . / -) ---------------
MATCH_NOISE = r"[^\p{L}\p{N}_./-]+"
MATCH_EDGES = "./- "


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    A column captured inside a lambda is evaluated for every element once the optimizer
    has inlined it; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, line breaks included."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def lines(text: Column) -> Column:
    """Array of lines.  Every kind of line break counts; CR LF adds one empty line,
    which no caller distinguishes from none."""
    unified = F.translate(text, _OTHER_LINE_BREAKS, "\n" * len(_OTHER_LINE_BREAKS))
    return F.split(unified, "\n", -1)


def norm_text(text: Column) -> Column:
    """Value text without quotes, edges and trailing punctuation; placeholders give NULL."""
    bare = strip(F.btrim(strip(text), F.lit("\"'")))
    longest = max(map(len, dims.NULL_TOKENS))

    def keep(value: Column) -> Column:
        # cheap tests first: few values are short enough or start like a placeholder
        token = (F.length(value) <= longest) & F.array_contains(dims.string_array(dims.NULL_TOKENS), F.lower(value))
        placeholder = value.startswith("<") & value.rlike(dims.PLACEHOLDER_PATTERN)
        return F.when(~(token | placeholder), value)

    return let(F.rtrim(bare, F.lit(WHITESPACE + ",.;")), keep)


def norm_value(value: Column, kind: Column | None = None) -> Column:
    """Normalise text values; numbers, booleans and nested values pass through."""
    if kind is None:
        return norm_text(value)
    return F.when(kind == "string", norm_text(value)).when(kind != "null", value)


def norm_field_name(name: Column) -> Column:
    """Snake-case a field name and resolve synonyms."""
    snake = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return let(snake, lambda key: F.coalesce(F.try_element_at(dims.literal_map(dims.FIELD_ALIASES), key), key))


# ---- the same two for the JSON kernel, which has the values at hand as Python texts -------------

_NOT_IN_NAMES = re.compile("[^a-z0-9]+")
_PLACEHOLDER = re.compile(dims.PLACEHOLDER_PATTERN)
_TOKENS = frozenset(dims.NULL_TOKENS)
_LONGEST_TOKEN = max(map(len, dims.NULL_TOKENS))
NAMES_KEPT = 50_000
_NAMES: dict[str, str] = {}  # names repeat from reply to reply


def canonical_name(name: str) -> str:
    """``norm_field_name`` of one text."""
    found = _NAMES.get(name)
    if found is None:
        snake = _NOT_IN_NAMES.sub("_", name.lower()).strip("_")
        found = dims.FIELD_ALIASES.get(snake, snake)
        if len(_NAMES) >= NAMES_KEPT:
            _NAMES.clear()
        if len(name) <= 200:
            _NAMES[name] = found
    return found


def clean_text(text: str) -> str | None:
    """``norm_text`` of one text."""
    value = text.strip(WHITESPACE).strip("\"'").strip(WHITESPACE).rstrip(WHITESPACE + ",.;")
    if len(value) <= _LONGEST_TOKEN and value.lower() in _TOKENS:
        return None
    return None if value[:1] == "<" and _PLACEHOLDER.search(value) else value


def norm_match(value: Column) -> Column:
    """Comparison form of a value: case-folded, punctuation squeezed; empty gives NULL."""
    folded = F.regexp_replace(F.lower(value), MATCH_NOISE, " ")
    return F.nullif(F.btrim(folded, F.lit(MATCH_EDGES)), F.lit(""))


def exact_match(predicted: Column, expected: Column) -> Column:
    """Equality of comparison forms; NULL equals NULL only.

    Identical texts, the usual case, are settled before any normalisation.
    """
    identical = F.coalesce(predicted == expected, F.lit(False))
    return identical | norm_match(predicted).eqNullSafe(norm_match(expected))


def reply_strip_chat(decoded: Column, prompt: Column | None = None, markers=ASSISTANT_MARKERS) -> Column:
    """Text after the last assistant marker, else after the echoed prompt, trimmed."""
    own_words = None
    for marker in markers:
        branch = (F.contains(decoded, F.lit(marker)), strip(F.substring_index(decoded, marker, -1)))
        own_words = F.when(*branch) if own_words is None else own_words.when(*branch)
    if prompt is not None:
        echoed = (F.length(prompt) > 0) & F.contains(decoded, prompt)
        after = F.substr(decoded, F.instr(decoded, prompt) + F.length(prompt))
        own_words = own_words.when(echoed, strip(after))
    return own_words.otherwise(strip(decoded))


def round4(value: Column) -> Column:
    """A double from 0 to 1 rounded to 4 places by its exact binary value.

    SQL ROUND works on the printed decimal and breaks ties upward; here an exact tie goes
    to the even digit (1/32 gives 0.0312) and any other tie to the side its double lies
    on.  Only a printed tie takes the exact path, the rest is one ROUND.
    """
    printed = value.cast("decimal(12,5)")
    units = (printed * 100000).cast("bigint")
    tie = (units % 10 == 5) & (printed.cast("double") == value)
    low = F.floor(units / F.lit(10))
    scaled = value * F.lit(float(2**62))  # exact: a power of two
    whole = scaled.cast("bigint")
    above = (
        whole.cast("decimal(19,0)") * F.lit(100000).cast("decimal(6,0)")
        - units.cast("decimal(7,0)") * F.lit(2**62).cast("decimal(19,0)")
    ).cast("double") + (scaled - whole.cast("double")) * 100000
    up = (above > 0) | ((above == 0) & (low % 2 == 1))
    return F.when(tie, (low + up.cast("int")) / F.lit(10000)).otherwise(F.round(value, 4))


def ratio4(correct: Column, total: Column) -> Column:
    """``correct / total`` rounded to 4 places; NULL when the total is 0."""
    return round4(F.try_divide(correct.cast("double"), total.cast("double")))
