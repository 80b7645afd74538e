"""Which search a raw query string stands for.

The rules in short: a blank query is empty; a query that starts and ends with a
double quote keeps its quotes and operators; a query with a special character or
an upper-case AND, OR, NOT anywhere is one phrase; everything else is a list of
words that must all occur, where ``^word`` asks for the first token of the text
and ``a + b`` joins words to a phrase.

``classify_queries`` holds the rules as column expressions for tables of queries,
``classify_query`` applies them to a single query without a Spark job.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.porter import stem_tokens, stem_word
from ..functions.text import _col, tokenize, tokenize_str

# What turns a query into one phrase.
SPECIAL_PATTERN = r"""["'\-*:.()]|AND|OR|NOT"""
# Characters of a bare word, and of white space between words.
WORD_CHARS = r"A-Za-z0-9_\x1a\x{80}-\x{10ffff}"
BLANKS = r" \t\n\r"

_QUOTED = r'"(?:[^"]|"")*"'
# A filter on the one column there is, before the rest of a quoted query.
_COLUMN = rf'^"(?i:content)"[{BLANKS}]*:[{BLANKS}]*'
# Outlines that no grammar of the full-text engine allows: another character, two
# operators in a row, a comma or brace outside of its construct, another column.
_MALFORMED = (r"[^Q A-Za-z0-9_\x1a\x{80}-\x{10ffff}()+:^*{}\-,]",
              r"(AND|OR|NOT|\+) ?(AND|OR|NOT|\+)( |$)", r"^[^(]*,", r"Q :", r"^[^(]*\)")


@dataclass(frozen=True)
class Unit:
    """What is found and scored as one: a word, or words in a row.

    ``prefix`` takes the last word as a prefix, ``first`` asks for a match at
    the start of the text.
    """

    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Query:
    """``mode``: empty, invalid, complex, all, any or not."""

    mode: str
    units: tuple[Unit, ...] = ()
    excluded: tuple[Unit, ...] = ()


def _part(text: Column, first: Column, required: Column) -> Column:
    return F.struct(text.alias("text"), first.alias("first"), required.alias("required"))


def _bare_parts(query: Column) -> Column:
    """Units of a query without quotes: blank-separated words."""
    joined = F.regexp_replace(query, rf"[{BLANKS}]*\+[{BLANKS}]*", "+")
    marked = F.regexp_replace(joined, rf"\^[{BLANKS}]*", " ^")
    words = F.filter(F.split(marked, rf"[{BLANKS}]+"), lambda w: w != "")
    return F.transform(words, lambda w: _part(w, F.startswith(w, F.lit("^")), F.lit(True)))


def _quoted_parts(query: Column, outline: Column) -> Column:
    """Units of a quoted query; all but the first are negated in a NOT chain."""
    strings = F.regexp_extract_all(query, F.lit(_QUOTED), F.lit(0))
    strings = F.when(F.startswith(outline, F.lit("Q +")),
                     F.array(F.array_join(strings, " "))).otherwise(strings)
    negated = F.startswith(outline, F.lit("Q NOT"))
    return F.transform(strings, lambda s, i: _part(s, F.lit(False), ~negated | (i == 0)))


def _item(terms: Column, part: Column) -> Column:
    return F.struct(terms.alias("terms"), part["first"].alias("first"),
                    part["required"].alias("required"))


def classify_queries(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Add ``mode`` and ``items``, an array of (terms, first, required).

    Terms are folded, not stemmed. Modes: ``empty`` (nothing can match),
    ``invalid`` (malformed: no rows, no error), ``all``, ``any``, ``not``, and
    ``complex`` for quoted queries that mix operators or use parentheses; those
    are to be written with the search operators instead. ``"content" : `` before a
    quoted query names the only column and changes nothing.
    """
    query = F.regexp_replace(_col(query_col), _COLUMN, "")
    blank = query.isNull() | ~F.rlike(query, F.lit(r"(?U)[^\s\x1c-\x1f]"))
    quoted = F.startswith(query, F.lit('"')) & F.endswith(query, F.lit('"'))
    special = F.rlike(query, F.lit(SPECIAL_PATTERN))
    # The outline of a quoted query: each string becomes Q, blanks become one.
    outline = F.trim(F.regexp_replace(
        F.regexp_replace(query, _QUOTED, " Q "), rf"[{BLANKS}]+", " "))
    broken = (F.rlike(query, F.lit(rf"[^{WORD_CHARS}{BLANKS}^+]"))
              | F.rlike(query, F.lit(rf"(^|[\^+])[{BLANKS}]*\+"))
              | F.rlike(query, F.lit(rf"[\^+][{BLANKS}]*($|[\^+])")))
    shape = (F.when(blank, "blank").when(quoted, "quoted")
             .when(special, "special").when(broken, "broken").otherwise("bare"))
    shape_col, outline_col = F.col("_shape"), F.col("_outline")
    out = queries.withColumn("_shape", shape).withColumn("_outline", outline)

    nothing_at_all = F.array().cast("array<struct<text:string,first:boolean,required:boolean>>")
    parts = (F.when(shape_col == "quoted", _quoted_parts(query, outline_col))
             .when(shape_col == "special", F.array(_part(query, F.lit(False), F.lit(True))))
             .when(shape_col == "bare", _bare_parts(query))
             .otherwise(nothing_at_all))
    out = out.withColumn("_parts", parts)
    out = out.withColumn("_items", F.transform(
        "_parts", lambda p: _item(tokenize(p["text"]), p)))

    malformed = F.contains(outline_col, F.lit('"'))
    for pattern in _MALFORMED:
        malformed |= F.rlike(outline_col, F.lit(pattern))
    quoted_mode = (F.when(malformed, "invalid")
                   .when(F.rlike(outline_col, F.lit(r"^Q( Q)*$")), "all")
                   .when(F.rlike(outline_col, F.lit(r"^Q( \+ Q)+$")), "all")
                   .when(F.rlike(outline_col, F.lit(r"^Q( AND Q)+$")), "and")
                   .when(F.rlike(outline_col, F.lit(r"^Q( OR Q)+$")), "any")
                   .when(F.rlike(outline_col, F.lit(r"^Q( NOT Q)+$")), "not")
                   .otherwise("complex"))
    mode = (F.when(shape_col == "blank", "empty").when(shape_col == "broken", "invalid")
            .when(shape_col == "quoted", quoted_mode).otherwise("all"))
    out = out.withColumn("mode", mode)
    none = F.array().cast("array<struct<terms:array<string>,first:boolean,required:boolean>>")

    # Strings without any token are left out, except that an AND or the left
    # side of a NOT cannot hold with one.
    kept = F.filter("_items", lambda x: F.size(x["terms"]) > 0)
    hollow = F.exists("_items", lambda x: (F.size(x["terms"]) == 0) & x["required"])
    nothing = ((F.col("mode").isin("and", "not") & hollow)
               | (F.col("mode").isin("all", "any", "not") & (F.size(kept) == 0)))
    plain = F.col("mode").isin("all", "and", "any", "not") & ~nothing
    final = (F.when(nothing, "empty").when(F.col("mode") == "and", "all")
             .otherwise(F.col("mode")))
    return (out.withColumn("items", F.when(plain, kept).otherwise(none))
            .withColumn("mode", final).drop("_shape", "_outline", "_parts", "_items"))


def stemmed_items(classified: DataFrame, stem: bool) -> DataFrame:
    """Stem the terms of ``items`` of classified queries."""
    if not stem:
        return classified
    flat = F.flatten(F.transform("items", lambda x: x["terms"]))
    rows = classified.withColumn("_stems", stem_tokens(flat))
    # Where each unit's terms start in the flat array of stems.
    sizes = F.transform("items", lambda x: F.size(x["terms"]))
    rows = rows.withColumn("_sizes", sizes)
    start = F.transform("_sizes", lambda s, i: F.aggregate(
        F.slice("_sizes", F.lit(1), i), F.lit(0), lambda a, b: a + b))
    rows = rows.withColumn("_starts", start)
    stems, starts, lengths = F.col("_stems"), F.col("_starts"), F.col("_sizes")
    items = F.transform("items", lambda x, i: _item(
        F.slice(stems, F.get(starts, i) + 1, F.get(lengths, i)), x))
    return rows.withColumn("items", items).drop("_stems", "_starts", "_sizes")


def _outline_mode(outline: str) -> str:
    """Mode of a quoted query whose strings are written as Q."""
    if '"' in outline or any(re.search(p.replace("\\x{80}-\\x{10ffff}", "\x80-\U0010ffff"), outline)
                             for p in _MALFORMED):
        return "invalid"
    for pattern, mode in ((r"Q( Q)*", "all"), (r"Q( \+ Q)+", "all"), (r"Q( AND Q)+", "and"),
                          (r"Q( OR Q)+", "any"), (r"Q( NOT Q)+", "not")):
        if re.fullmatch(pattern, outline):
            return mode
    return "complex"


def _parts(query: str) -> tuple[str, list[tuple[str, bool, bool]]]:
    """Mode of a query that is not blank, and (text, first, required) of its units."""
    query = re.sub(_COLUMN, "", query)
    if query.startswith('"') and query.endswith('"'):
        strings = re.findall(_QUOTED, query)
        outline = re.sub(rf"[{BLANKS}]+", " ", re.sub(_QUOTED, " Q ", query)).strip(" ")
        if outline.startswith("Q +"):
            strings = [" ".join(strings)]
        negated = outline.startswith("Q NOT")
        return _outline_mode(outline), [(s, False, not negated or i == 0)
                                        for i, s in enumerate(strings)]
    if re.search(SPECIAL_PATTERN, query):
        return "all", [(query, False, True)]
    word = r"A-Za-z0-9_\x1a\x80-\U0010ffff"
    if (re.search(rf"[^{word}{BLANKS}^+]", query) or re.search(rf"(^|[\^+])[{BLANKS}]*\+", query)
            or re.search(rf"[\^+][{BLANKS}]*(\Z|[\^+])", query)):
        return "invalid", []
    joined = re.sub(rf"[{BLANKS}]*\+[{BLANKS}]*", "+", query)
    words = re.split(rf"[{BLANKS}]+", re.sub(rf"\^[{BLANKS}]*", " ^", joined))
    return "all", [(w, w.startswith("^"), True) for w in words if w]


def classify_query(query: str | None, stem: bool = True) -> Query:
    """The same rules for one query, worked out on the driver, with stemmed terms."""
    if query is None or not query.strip():
        return Query("empty")
    mode, parts = _parts(query)
    if mode in ("invalid", "complex"):
        return Query(mode)
    units = [(required, Unit(analyze(text, stem), first=first)) for text, first, required in parts]
    hollow = any(required and not unit.terms for required, unit in units)
    units = [(required, unit) for required, unit in units if unit.terms]
    if not units or (hollow and mode in ("and", "not")):
        return Query("empty")
    return Query("all" if mode == "and" else mode,
                 tuple(u for required, u in units if required),
                 tuple(u for required, u in units if not required))


def analyze(text: str, stem: bool = True) -> tuple[str, ...]:
    """Terms of a short text given by the caller, folded and stemmed."""
    return tuple(stem_word(t) if stem else t for t in tokenize_str(text))
