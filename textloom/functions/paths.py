"""Path pattern matching and previews."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# Fixed value: characters of content shown by a path search.
PREVIEW_CHARS = 200


def path_like(path: Column | str, pattern: str) -> Column:
    """LIKE with ``%`` and ``_``; A-Z match a-z; there is no escape character."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    wanted = pattern.translate(str.maketrans(upper, lower)).replace("\\", "\\\\")
    return F.translate(_col(path), upper, lower).like(wanted)


def preview(content: Column | str) -> Column:
    """The first 200 characters, with dots when the cut is exactly that long."""
    head = F.substring(_col(content), 1, PREVIEW_CHARS)
    return F.when(F.length(head) == PREVIEW_CHARS, F.concat(head, F.lit("..."))).otherwise(head)
