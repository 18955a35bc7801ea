"""Sentence windows, token counts and text predicates as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill import settings

# Two Unicode noncharacters: reserved for use inside a process, never part of stored text.
_DOTS = "\ufdd0"
_CUT = "\ufdd1"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`.

    Stacked projections would be inlined into every lambda that reads them and be evaluated
    once per array element.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Trim Unicode blanks on both ends."""
    return F.btrim(text, F.lit(settings.BLANKS))


def token_count(text: Column, pattern: str = settings.TOKEN) -> Column:
    """Number of tokens; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def truncate_tokens(
    text: Column, limit: int = settings.MAX_MODEL_TOKENS, pattern: str = settings.TOKEN
) -> Column:
    """The first `limit` tokens as an array."""
    return F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), 1, limit)


def first_tokens(
    text: Column, limit: int = settings.MAX_MODEL_TOKENS, pattern: str = settings.TOKEN
) -> Column:
    """The text itself, or of a longer one the first `limit` tokens set apart by blanks."""
    short = token_count(text, pattern) <= limit
    return F.when(short, text).otherwise(F.array_join(truncate_tokens(text, limit, pattern), " "))


def sentences(text: Column) -> Column:
    """Array of sentences: a cut after each run of `.!?`, where `...` is no end of sentence."""
    kept = F.replace(text, F.lit("..."), F.lit(_DOTS))
    cut = F.regexp_replace(kept, "[.!?]+", "$0" + _CUT)
    parts = F.transform(
        F.split(cut, _CUT), lambda s: strip(F.replace(s, F.lit(_DOTS), F.lit("...")))
    )
    return F.coalesce(F.filter(parts, lambda s: s != ""), F.array().cast("array<string>"))


def _slide(items: Column, size: int, stride: int, whole: Callable, window: Callable) -> Column:
    count = F.size(items)
    starts = F.sequence(F.lit(0), F.greatest(count - size, F.lit(0)), F.lit(stride))
    many = F.transform(starts, lambda i: window([F.get(items, i + j) for j in range(size)]))
    one = F.array(whole(items))
    return F.when(count == 0, F.slice(many, 1, 0)).when(count <= size, one).otherwise(many)


def windows(
    items: Column, size: int = settings.WINDOW_SENTENCES, stride: int = settings.WINDOW_STRIDE
) -> Column:
    """Array of texts, each made of `size` neighbouring sentences; all of them if there are few."""
    return _slide(
        items,
        size,
        stride,
        lambda all_items: F.array_join(all_items, " "),
        lambda picked: F.concat_ws(" ", *picked),
    )


def chunks(
    text: Column,
    size: int = settings.WINDOW_SENTENCES,
    stride: int = settings.WINDOW_STRIDE,
    min_tokens: int = settings.MIN_TOKENS,
    pattern: str = settings.TOKEN,
) -> Column:
    """Array of `struct(chunk, tokens)`: the windows of at least `min_tokens` tokens.

    When every window is too short the unchanged text is the only chunk. Tokens never reach over
    the blank between two sentences, so each sentence is counted once and windows add up.
    """
    counted = F.transform(
        sentences(text),
        lambda s: F.struct(s.alias("s"), F.regexp_count(s, F.lit(pattern)).alias("n")),
    )

    def whole(items: Column) -> Column:
        total = F.aggregate(items, F.lit(0), lambda acc, x: acc + x["n"])
        joined = F.array_join(F.transform(items, lambda x: x["s"]), " ")
        return F.struct(joined.alias("chunk"), total.alias("tokens"))

    def window(picked: list[Column]) -> Column:
        total = picked[0]["n"]
        for item in picked[1:]:
            total = total + item["n"]
        joined = F.concat_ws(" ", *[item["s"] for item in picked])
        return F.struct(joined.alias("chunk"), total.alias("tokens"))

    def keep(made: Column) -> Column:
        long_enough = F.filter(made, lambda c: c["tokens"] >= min_tokens)
        fallback = F.struct(text.alias("chunk"), token_count(text, pattern).alias("tokens"))
        return bind(
            long_enough,
            lambda kept: F.when((F.size(kept) == 0) & (F.size(made) > 0), F.array(fallback))
            .otherwise(kept),
        )

    return bind(counted, lambda items: bind(_slide(items, size, stride, whole, window), keep))


def is_empty_body(text: Column) -> Column:
    """True for null and for the words that stand for a missing post."""
    return F.coalesce(F.lower(text).isin(*settings.EMPTY_BODIES), F.lit(True))


def has_removal_mark(text: Column) -> Column:
    found = F.lit(False)
    for mark in settings.REMOVAL_MARKS:
        found = found | F.contains(text, F.lit(mark))
    return found


def non_ascii_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / F.length(text)


def mostly_ascii(text: Column, below: float = 0.2) -> Column:
    """False for null and empty text."""
    checked = F.when(F.length(text) > 0, non_ascii_share(text) < below)
    return F.coalesce(checked, F.lit(False))


def preview(text: Column, width: int = 78) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, width)


def percent(share: Column) -> Column:
    """A share as percent with one decimal, ties to the even digit."""
    return F.format_string("%.1f%%", F.bround(share * 100, 1))
