"""License scans: exact phrases, and short notices with a bounded number of edits.

A notice with at most k edits holds at least one of its k + 1 disjoint parts unchanged
(pigeonhole). All parts of all notices are found in one pass over the words of a text;
only around such seeds does the ``regex`` library match the notice with that many
errors, on a window that is as long as the notice and its edits can be. A match gives
a label, its edits, and its span: its first word, and characters of the lower-cased
words joined by single spaces.

Defined cases: null texts are empty; no place gives null first and last words, empty
labels and score 0; equal rows are scanned alike; long texts are scanned whole;
columns other than the id are not carried over.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.columns import as_text, lower_ascii
from textloom.plans.workdir import ship_package

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Phrases of the base rule with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Short notices in words, with their labels and the edits (characters) allowed.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", 3),
    ("mit", "released under the mit license", 2),
    ("mit", "licensed under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    ("gpl-3.0", "licensed under the gnu general public license version 3", 4),
    ("gpl-2.0", "gnu general public license version 2", 3),
    ("lgpl", "gnu lesser general public license", 3),
    ("cc-by-4.0", "licensed under cc by 4 0", 1),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", 2),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", 2),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 5),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", 5),
    ("reserved-notice", "all rights reserved", 1),
]


def seeds_of(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 parts that cover a notice, with where each begins."""
    n, parts = len(notice), edits + 1
    ends = [n * k // parts for k in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(ends, ends[1:])]


class Scanner:
    def __init__(self, notices=tuple(NOTICES), phrases=tuple(PHRASES.items())):
        self.phrases = [(f" {p} ", label) for p, label in phrases]
        self.notices = [(label, text, edits, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={edits}}}"))
                        for label, text, edits in notices]
        self.seeds = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, edits) in enumerate(notices):
            for start, part in seeds_of(text, edits):
                places.setdefault(part, []).append((k, start))
        for part, uses in places.items():
            self.seeds.add_word(part, (len(part), uses))
        self.seeds.make_automaton()

    def base(self, line: str) -> list[tuple[int, str]]:
        """(character, label) of every place of a phrase; ``line`` is " word word ... "."""
        found = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = line.find(phrase, at + 1)
        return found

    def notices_in(self, line: str) -> list[tuple[str, int, int, int]]:
        """(label, edits, start, end) of the notices in a line.

        Of matches that overlap, the one with the fewest edits stays, then the longest.
        """
        windows: dict[int, set[int]] = {}
        for end, (length, uses) in self.seeds.iter(line):
            for k, offset in uses:
                windows.setdefault(k, set()).add(end + 1 - length - offset)
        found = set()
        for k, starts in windows.items():
            label, text, edits, pattern = self.notices[k]
            reach = 0
            for start in sorted(starts):
                high = min(len(line), start + len(text) + edits)
                # From where the last match ends; what overlaps it is looked at if nothing is left.
                low = max(0, start - edits)
                m = pattern.search(line, max(low, reach), high) or (low < reach < high and pattern.search(line, low, high))
                if m:
                    found.add((label, sum(m.fuzzy_counts), m.start(), m.end()))
                    reach = max(reach, m.end())
        kept: list[tuple[int, int, str, int]] = []   # start, end, label, edits: apart, by start
        for label, edits, a, b in sorted(found, key=lambda f: (f[1], f[2] - f[3], f[2], f[0])):
            at = bisect_left(kept, (a,))
            if (not at or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
                kept.insert(at, (a, b, label, edits))
        return [(label, edits, a, b) for a, b, label, edits in kept]

    def scan(self, text: str) -> dict:
        """All findings of a lower-cased text."""
        words = WORDS.findall(text)
        line = f" {' '.join(words)} "
        base, fuzzy = self.base(line), self.notices_in(line)
        # Where each word begins; made once, and only if something was found.
        begins = list(accumulate((len(w) + 1 for w in words), initial=1)) if base or fuzzy else []
        starts = [bisect_left(begins, at + 1) for at, _ in base]
        # A match may begin inside a word or with the space before one.
        spans = [{"label": label, "edits": edits, "word": max(0, bisect_right(begins, a + (line[a] == " ")) - 1),
                  "start": a - 1, "end": b - 1} for label, edits, a, b in fuzzy]
        score = 1.0 if base else max([1 - e / (b - a) for _, e, a, b in fuzzy], default=0.0)
        return {"n_words": len(words), "n_base": len(base),
                "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                "base_labels": sorted({label for _, label in base}),
                "labels": sorted({label for _, label in base} | {f[0] for f in fuzzy}),
                "spans": spans,
                "score": max(0.0, min(1.0, score))}


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


SCHEMA = ("id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
          "labels array<string>, spans array<struct<label:string,edits:int,word:int,start:int,end:int>>, score double")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score) of every row."""
    ship_package(docs.sparkSession)
    span = pa.list_(pa.struct([("label", pa.string()), ("edits", pa.int32()), ("word", pa.int32()),
                               ("start", pa.int32()), ("end", pa.int32())]))
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
             "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "spans": span,
             "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = scanner()
        for batch in batches:
            rows = [made.scan(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[name] for r in rows], kind) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *kinds])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), lower_ascii(as_text(text_col)).alias("text"))
            .mapInArrow(run, SCHEMA.format(kind=kind)).withColumnRenamed("id", id_col))
