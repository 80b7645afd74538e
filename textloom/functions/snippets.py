"""Highlighted snippets, for the few rows of a result list.

Runs after the top k are chosen: the helper sees k texts per query, never the
corpus. The best window of ``width`` tokens holds as many different phrases as
possible, then as many hits, preferably from the start of a sentence.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .porter import stem_word
from .text import TOKEN_RE, fold_str

# Marks, window width and the weights of a window.
OPEN, CLOSE, ELLIPSIS = "<mark>", "</mark>", "..."
WIDTH = 32
NEW_PHRASE, REPEATED_PHRASE = 1000, 1
TEXT_START, SENTENCE_START = 120, 100

_SENTENCE_GAP = re.compile(r"[.:][ \t\n\r]+")


@lru_cache(maxsize=1 << 16)
def _term(raw: str, stem: bool) -> str:
    return stem_word(fold_str(raw)) if stem else fold_str(raw)


def _phrase_hits(terms: list[str], phrases: list[tuple]) -> list[tuple[int, int]]:
    """(first token, phrase number) of every occurrence, in text order."""
    places: dict[str, list[int]] = {}
    for at, term in enumerate(terms):
        places.setdefault(term, []).append(at)
    hits = []
    for number, (words, prefix, first) in enumerate(phrases):
        last = len(words) - 1
        if prefix and last == 0:
            starts = [at for t, found in places.items() if t.startswith(words[0]) for at in found]
        else:
            starts = places.get(words[0], [])
        for at in starts:
            there = terms[at:at + last + 1]
            if (first and at > 0) or len(there) <= last or there[:last] != words[:last]:
                continue
            if there[last] == words[last] or (prefix and there[last].startswith(words[last])):
                hits.append((at, number))
    return sorted(hits)


def _window_score(hits, phrases, start: int, width: int) -> tuple[int, int, int]:
    """Weight of the window at ``start``, and where its hits begin and end."""
    seen, weight, first, last = set(), 0, start, start
    begin = bisect_left(hits, (start, -1))
    for at, number in hits[begin:bisect_left(hits, (start + width, -1), begin)]:
        if not seen:
            first = at
        weight += REPEATED_PHRASE if number in seen else NEW_PHRASE
        seen.add(number)
        last = at + len(phrases[number][0])
    return weight, first, last


def _best_window(text, spans, hits, phrases, width: int) -> int:
    n = len(spans)
    gap_ends = {m.end() for m in _SENTENCE_GAP.finditer(text)}
    sentences = [i for i, (begin, _) in enumerate(spans) if i == 0 or begin in gap_ends]
    best_weight, best_start = 0, 0
    for at, _ in hits:
        weight, first, last = _window_score(hits, phrases, at, width)
        if weight > best_weight:
            middle = first - int((width - (last - first)) / 2)
            best_weight, best_start = weight, max(0, min(middle, n - width))
        if n > width:
            sentence = sentences[bisect_right(sentences, at) - 1]
            if sentence < at:
                weight, _, _ = _window_score(hits, phrases, sentence, width)
                weight += TEXT_START if sentence == 0 else SENTENCE_START
                if weight > best_weight:
                    best_weight, best_start = weight, sentence
    return best_start


def make_snippet(text: str, phrases: list[tuple], stem: bool = True, width: int = WIDTH) -> str:
    """The best window of a text; ``phrases`` are (words, prefix, first) triples."""
    spans = [m.span() for m in TOKEN_RE.finditer(text)]
    terms = [_term(text[a:b], stem) for a, b in spans]
    hits = _phrase_hits(terms, phrases)
    start = _best_window(text, spans, hits, phrases, width)
    end = min(start + width, len(spans))
    marked = []  # token ranges to highlight, overlapping ones as one
    for at, number in hits:
        stop = at + len(phrases[number][0])
        if stop <= start or at >= end:
            continue
        if marked and at < marked[-1][1]:
            marked[-1][1] = max(marked[-1][1], stop)
        else:
            marked.append([at, stop])
    out = [ELLIPSIS] if start > 0 else []
    done = spans[start][0] if start > 0 else 0
    for at, stop in marked:
        left, right = spans[max(at, start)][0], spans[min(stop, end) - 1][1]
        out += [text[done:left], OPEN, text[left:right], CLOSE]
        done = right
    if end < len(spans):
        out += [text[done:spans[end - 1][1]], ELLIPSIS]
    else:
        out.append(text[done:])
    return "".join(out)


def snippet(text: Column | str, phrases: Column | str, stem: bool = True,
            width: int = WIDTH) -> Column:
    """Snippet column; ``phrases`` is an array of (terms, prefix, first)."""
    def batch(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else make_snippet(
                t, [(list(p["terms"]), p["prefix"], p["first"]) for p in w], stem, width)
            for t, w in zip(texts, wanted)], dtype=object)

    return F.pandas_udf(batch, "string")(text, phrases)
