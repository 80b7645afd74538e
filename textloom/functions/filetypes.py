"""Column predicates over file names and raw file content.

All of them are native expressions over ``path`` (string) and ``content``
(binary), so a scan can apply them without leaving the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# File name extensions that are taken as text.
TEXT_EXTENSIONS = (
    ".txt", ".md", ".rst", ".log", ".csv", ".json", ".xml", ".html",
    ".htm", ".css", ".js", ".py", ".java", ".c", ".cpp", ".h", ".hpp",
    ".cs", ".rb", ".go", ".rs", ".php", ".sh", ".bat", ".ps1", ".yaml",
    ".yml", ".toml", ".ini", ".cfg", ".conf", ".properties",
)

# Leading bytes of well-known binary formats.
BINARY_SIGNATURES = (
    b"\x00\x00\x00",      # NUL bytes
    b"\xff\xfe",          # UTF-16/32 little endian
    b"\xfe\xff",          # UTF-16 big endian
    b"\x00\x00\xfe\xff",  # UTF-32 big endian
    b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08",  # zip
    b"\x1f\x8b",          # gzip
    b"BZh",               # bzip2
    b"\x89PNG",
    b"GIF87a", b"GIF89a",
    b"\xff\xd8\xff",      # jpeg
    b"ID3",               # mp3
    b"RIFF",              # wav, avi
    b"%PDF",
)

# Characters the encoding probe asks for, and the default extensions
# of a scan.
PROBE_CHARS = 1024
DEFAULT_EXTENSIONS = (".txt", ".md", ".rst")

_BOM = b"\xef\xbb\xbf"
# Byte tails which complete a UTF-8 sequence that was cut by the end of a probe.
_COMPLETIONS = (b"\x80", b"\x80\x80", b"\xa0\x80", b"\x80\x80\x80", b"\x90\x80\x80")


def _bytes(value: bytes) -> Column:
    return F.lit(bytearray(value))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """Lower-cased last extension of the file name, or an empty string.

    The dot must be neither the first nor the last character of the name.
    """
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def has_extension(ext: Column | str, included: Iterable[str] = (),
                  excluded: Iterable[str] = ()) -> Column:
    """Include list (empty = everything), then exclude list, compared as given."""
    ext = _col(ext)
    keep = ext.isin(*included) if included else F.lit(True)
    return keep & ~ext.isin(*excluded) if excluded else keep


def within_size(size: Column | str, max_mb: float | None = None) -> Column:
    """Whether a file is no larger than a cap; without a cap all are."""
    if max_mb is None:
        return F.lit(True)
    return _col(size) <= F.lit(int(max_mb * 1024 * 1024))


def has_text_extension(ext: Column | str) -> Column:
    return _col(ext).isin(*TEXT_EXTENSIONS)


def has_binary_signature(content: Column | str) -> Column:
    content = _col(content)
    return reduce(lambda a, b: a | b,
                  [F.startswith(content, _bytes(s)) for s in BINARY_SIGNATURES])


def has_nul(content: Column | str, probe_bytes: int | None = None) -> Column:
    """Whether there is a NUL in the content, or in its first ``probe_bytes``."""
    content = _col(content)
    looked_at = content if probe_bytes is None else F.substring(content, 1, probe_bytes)
    return F.contains(looked_at, _bytes(b"\x00"))


def is_text(ext: Column | str, content: Column | str | None = None,
            probe_bytes: int | None = None) -> Column:
    """Known text extension and, when content is given, no sign of binary data."""
    if content is None:
        return has_text_extension(ext)
    return has_text_extension(ext) & ~has_binary_signature(content) & ~has_nul(content, probe_bytes)


def _valid_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def detect_encoding(content: Column | str, probe_bytes: int | None = None) -> Column:
    """``utf-8-sig``, ``utf-8`` or ``latin-1``, judged by the whole content.

    With ``probe_bytes`` (8192 is usual) only so many bytes are looked at. A
    multi-byte sequence cut by their end is then accepted when the file goes
    on after them, or when they already gave enough characters.
    """
    content = _col(content)
    with_bom = F.startswith(content, _bytes(_BOM))
    if probe_bytes is None:
        return (F.when(with_bom, "utf-8-sig").when(_valid_utf8(content), "utf-8")
                .otherwise("latin-1"))
    probe = F.substring(content, 1, probe_bytes)
    completed = reduce(lambda a, b: a | b,
                       [_valid_utf8(F.concat(probe, _bytes(t))) for t in _COMPLETIONS])
    # Half of a surrogate pair is no valid text, yet it is only rejected when complete.
    before = F.octet_length(probe) - 2
    half_surrogate = (F.rlike(F.hex(F.substring(probe, -2, 2)), F.lit("^ED[AB]"))
                      & _valid_utf8(F.substr(probe, F.lit(1), before)))
    completed = completed | half_surrogate
    # The cut tail counts as one character here, and a line end always as one.
    chars = F.length(F.regexp_replace(probe.cast("string"), "\r\n", "\n")) - 1
    may_be_cut = (F.octet_length(content) > probe_bytes) | (chars >= PROBE_CHARS)
    return (F.when(with_bom, "utf-8-sig")
            .when(_valid_utf8(probe) | (completed & may_be_cut), "utf-8")
            .otherwise("latin-1"))


def decode_text(content: Column | str, encoding: Column | str) -> Column:
    """Whole content as text with ``\\n`` line ends; NULL when it is not decodable."""
    content, encoding = _col(content), _col(encoding)
    as_utf8 = F.when(_valid_utf8(content), content.cast("string"))
    text = (F.when(encoding == "latin-1", F.decode(content, "ISO-8859-1"))
            .when(encoding == "utf-8-sig", F.regexp_replace(as_utf8, "^﻿", ""))
            .otherwise(as_utf8))
    return F.regexp_replace(text, "\r\n?", "\n")
