"""Folding and tokenising text with built-in column expressions.

A token is a maximal run of letters, numbers and private-use characters. Before
tokenising, text is lower-cased and single diacritics are removed, so that
``Café`` and ``cafe`` are one term. Everything here is a native expression and
stays in the JVM.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The combining marks that are dropped inside a token.
DROPPED_MARKS = (
    "̀-̄̆-̛̌̏̑"
    "̣-̨̭̮̰̱"
)

# Lower-case letters with a folded form that lower() does not give.
EXTRA_FOLDS = {
    "µ": "μ",
    "ſ": "s",
    "ς": "σ",
    "ϐ": "β",
    "ϑ": "θ",
    "ϕ": "φ",
    "ϖ": "π",
    "ϰ": "κ",
    "ϱ": "ρ",
    "ϵ": "ε",
    "ẛ": "s",
    "ι": "ι",
}

TOKEN_PATTERN = r"[\p{L}\p{N}\p{Co}]+"

_MARK_RANGES = [(0x300, 0x304), (0x306, 0x30C), (0x30F, 0x30F), (0x311, 0x311),
                (0x31B, 0x31B), (0x323, 0x328), (0x32D, 0x32E), (0x330, 0x331)]


def is_dropped_mark(ch: str) -> bool:
    return any(lo <= ord(ch) <= hi for lo, hi in _MARK_RANGES)


def fold_table() -> dict[str, str]:
    """Lower-case letter -> folded letter.

    A letter is folded when it decomposes into one ASCII letter and exactly one
    dropped mark; a letter with two marks (``ế``) is kept as it is.
    """
    table = dict(EXTRA_FOLDS)
    for code in range(0xC0, 0x1F00):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if (len(parts) == 2 and parts[0].isascii() and parts[0].islower()
                and is_dropped_mark(parts[1])):
            table[ch] = parts[0]
    return table


_FOLDS = fold_table()
_FOLD_FROM = "".join(_FOLDS)
_FOLD_TO = "".join(_FOLDS.values())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(text: Column | str) -> Column:
    """Lower-cased text without single diacritics.

    Pure ASCII text, recognised by its byte length, takes the short way.
    """
    text = _col(text)
    folded = F.translate(
        F.regexp_replace(F.lower(text), f"[{DROPPED_MARKS}]", ""),
        _FOLD_FROM, _FOLD_TO)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(folded)


def tokenize(text: Column | str) -> Column:
    """Array of folded tokens in text order (not stemmed)."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN_PATTERN), F.lit(0))


# The same rules for the short strings that the driver or a helper handles.
_START = "[^\\W_]|[\ue000-\uf8ff\U000f0000-\U0010fffd]"
_MARKS = "".join(chr(c) for c in range(0x300, 0x332) if is_dropped_mark(chr(c)))
TOKEN_RE = re.compile(f"(?:{_START})(?:{_START}|[{_MARKS}])*")


def fold_str(text: str) -> str:
    return "".join(_FOLDS.get(c, c) for c in text.lower() if not is_dropped_mark(c))


def tokenize_str(text: str) -> list[str]:
    return [fold_str(m.group()) for m in TOKEN_RE.finditer(text)]
