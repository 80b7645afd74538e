"""Vocabulary files of the tokenizers library, and texts as words to look up.

White space of ASCII never stands inside a token of a vocabulary that drops it, and no
step before the merges looks across it. So a text's ids are those of its words, one
after the other, and a task encodes each distinct word once.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_WORDS = 450_000       # words that a Python worker remembers before it starts anew
CHUNK_BYTES = 4 << 20      # text that is encoded before its ids are handed on


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict:
    """The parsed file; its pre-tokenizer must drop white space for words to stand alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
    if not any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] for s in steps):
        raise ValueError(f"{path}: the vocabulary keeps white space, so words can't be encoded alone")
    return spec


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    vocabulary(path)
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


# Words of these characters need no normaliser: lower case is all that it would do.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# Fixed value: the pattern of word_bpe files, for lower-cased plain words.
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


BYTES = _byte_characters()
PLAIN_BYTES = {c: "".join(BYTES[b] for b in chr(c).encode()) for c in range(128, 256)}


class Pieces:
    """Words as the pre-tokens of a vocabulary, in byte characters."""

    def __init__(self, path: str):
        spec = vocabulary(path)
        self.library = library(path)
        splits = [s["pattern"].get("Regex") for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        self.plain = splits == [PATTERN] and kinds == ["NFC", "Replace", "Lowercase"]
        self.specials = [t["content"] for t in spec["added_tokens"]]

    def of(self, word: str) -> list[str] | None:
        """None if a special token is in the word: it has to be encoded as it is."""
        if "<" in word and any(s in word for s in self.specials):
            return None
        if self.plain and PLAIN.fullmatch(word):
            found = PLAIN_PIECES.findall(word.lower())
            return found if word.isascii() else [p.translate(PLAIN_BYTES) for p in found]
        text = self.library.normalizer.normalize_str(word)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]


class WordIds:
    """Ids of words as little-endian 32-bit bytes, remembered up to a bound."""

    def __init__(self, path: str, piece_ids: Callable[[list[str]], bytes], most: int = KEPT_WORDS):
        """``piece_ids`` gives the ids of a word's pieces."""
        self.pieces, self.piece_ids, self.most, self.known = Pieces(path), piece_ids, most, {}

    def encode(self, word: bytes) -> bytes:
        text = word.decode()
        pieces = self.pieces.of(text)
        if pieces is None:
            return np.array(self.pieces.library.encode(text, add_special_tokens=False).ids, "<i4").tobytes()
        return self.piece_ids(pieces)

    def of(self, text: str) -> bytes:
        # Lone surrogates can't reach here from Arrow; bytes.split() knows ASCII's white space only.
        words = text.encode().split()
        known = self.known
        missing = {w for w in words if w not in known}
        if missing:
            if len(known) + len(missing) > self.most:
                known.clear()
                missing = set(words)
            for w in missing:
                known[w] = self.encode(w)
        return b"".join([known[w] for w in words])


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes of text; one long text is one range."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).cumsum()
    start = 0
    while start < len(texts):
        before = lengths[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(lengths, before + size, "right")))
        yield start, stop
        start = stop


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


def id_lists(parts: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))
