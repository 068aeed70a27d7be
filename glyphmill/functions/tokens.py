"""Identifier-aware tokens, as column expressions, and in Python for whole batches of texts."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z_][A-Za-z0-9_]*"
HUMPS = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"


def lower_ascii(c: Column) -> Column:
    """Lower case for A to Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def camel_split(token: Column) -> Column:
    """The humps and digit runs of an identifier without underscores."""
    return F.regexp_extract_all(token, F.lit(HUMPS), F.lit(0))


def split_identifier(token: Column) -> Column:
    """The lowered identifier, followed by its parts if it has two or more.

    With an underscore anywhere, only underscores part it; else case and digits do.
    """
    low = lower_ascii(token)
    snake = F.filter(F.split(low, "_"), lambda p: p != "")
    humps = F.transform(camel_split(token), lower_ascii)
    parts = F.when(token.contains("_"), snake).otherwise(humps)
    return F.when(~token.rlike("[A-Z0-9_]") | (F.size(parts) < 2), F.array(low)).otherwise(F.concat(F.array(low), parts))


def tokenize(text: Column) -> Column:
    """All tokens of a text, compound identifiers with their parts. Null gives none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(found, split_identifier))


def unique_tokens(text: Column) -> Column:
    """Tokens without repeats, in the order of their first appearance."""
    return F.array_distinct(tokenize(text))


_token, _humps, _plain = re.compile(TOKEN), re.compile(HUMPS), re.compile("[a-z]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_known: dict[str, tuple[str, ...]] = {}
#: Tokens whose parts a worker keeps: the frequent ones come again soon, most others are seen once.
KNOWN = 1 << 15


def parts_of(token: str) -> tuple[str, ...]:
    """:func:`split_identifier` of one token; those seen before are kept, up to a number."""
    got = _known.get(token)
    if got is None:
        if _plain.fullmatch(token):
            got = (token,)
        else:
            low = token.translate(_LOWER)
            got = (low,)
            more = [p for p in low.split("_") if p] if "_" in token else [h.translate(_LOWER) for h in _humps.findall(token)]
            if len(more) > 1:
                got = (low, *more)
        if len(_known) >= KNOWN:
            _known.clear()
        _known[token] = got
    return got


def term_counts(text: str | None) -> dict[str, int]:
    """How often each token of :func:`tokenize` occurs in a text."""
    out: dict[str, int] = {}
    for token, n in Counter(_token.findall(text or "")).items():
        for p in parts_of(token):
            out[p] = out.get(p, 0) + n
    return out


def ordered_terms(text: str | None) -> list[str]:
    """:func:`unique_tokens` of a text."""
    return list(dict.fromkeys(p for token in _token.findall(text or "") for p in parts_of(token)))
