"""Porter stemming (M. F. Porter, 1980) for arrays of tokens.

The stemmer is a small helper applied to the distinct tokens of an Arrow batch;
tokens repeat so much that almost all work is the dictionary encoding, which
Arrow does in native code. Spark keeps partitioning and scheduling.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The suffix rules of the published algorithm, steps 2 to 4,
# with "bli" and "logi" from the author's later revision of step 2.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance",
    "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]
MIN_BYTES, MAX_BYTES = 3, 64


def _shape(word: str) -> str:
    """One letter per character: v for vowel, c for consonant."""
    out = []
    prev = "v"
    for ch in word:
        prev = "v" if ch in "aeiou" or (ch == "y" and prev == "c" and out) else "c"
        out.append(prev)
    return "".join(out)


def _ends_short(word: str, shape: str) -> bool:
    return shape.endswith("cvc") and word[-1] not in "wxy"


def _suffix(word: str, suffixes) -> str | None:
    """The longest suffix that leaves at least one character."""
    fits = [s for s in suffixes if len(word) > len(s) and word.endswith(s)]
    return max(fits, key=len) if fits else None


def _plural(word: str) -> str:
    end = _suffix(word, ("sses", "ies", "ss", "s"))
    return word[: len(word) - {"sses": 2, "ies": 2, "s": 1}.get(end, 0)]


def _past(word: str) -> str:
    end = _suffix(word, ("eed", "ed", "ing"))
    if end is None:
        return word
    stem = word[: -len(end)]
    shape = _shape(stem)
    if end == "eed":
        return stem + "ee" if "vc" in shape else word
    if "v" not in shape:
        return word
    if _suffix(stem, ("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and stem[-1] not in "aeioulsz":
        return stem[:-1]
    if shape.count("vc") == 1 and _ends_short(stem, shape):
        return stem + "e"
    return stem


def _final_y(word: str) -> str:
    if word.endswith("y") and "v" in _shape(word[:-1]):
        return word[:-1] + "i"
    return word


def _replace(word: str, rules: dict[str, str]) -> str:
    end = _suffix(word, rules)
    if end is None or "vc" not in _shape(word[: -len(end)]):
        return word
    return word[: -len(end)] + rules[end]


def _derived(word: str) -> str:
    end = _suffix(word, STEP4)
    if end is None:
        return word
    stem = word[: -len(end)]
    if _shape(stem).count("vc") < 2 or (end == "ion" and stem[-1] not in "st"):
        return word
    return stem


def _final_e(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        shape = _shape(stem)
        measure = shape.count("vc")
        if measure > 1 or (measure == 1 and not _ends_short(stem, shape)):
            word = stem
    if word.endswith("ll") and _shape(word[:-1]).count("vc") > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=1 << 18)
def stem_word(word: str) -> str:
    """The stem of one folded token; short and very long tokens are kept."""
    raw = word.encode("utf-8")
    if not MIN_BYTES <= len(raw) <= MAX_BYTES:
        return word
    out = raw.decode("latin-1")
    out = _final_y(_past(_plural(out)))
    out = _replace(_replace(out, STEP2), STEP3)
    out = _final_e(_derived(out))
    return out.encode("latin-1").decode("utf-8", "replace")


def _stem_lists(tokens: pa.Array) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(tokens), 0)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()),
                                pc.cumulative_sum(lengths).cast(pa.int32())])
    encoded = tokens.flatten().dictionary_encode()
    stems = pa.array([stem_word(w) for w in encoded.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(offsets, stems.take(encoded.indices))


_stem_udf = F.arrow_udf(_stem_lists, ArrayType(StringType()))


def stem_tokens(tokens: Column | str) -> Column:
    """Stem every token of an array column; the array must not hold nulls."""
    return _stem_udf(tokens)
