"""Normal forms of keys: entry ids, content hashes, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_id(col: Column | str) -> Column:
    """Entry ids compare without surrounding white space and regardless of case; empty is null."""
    c = F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))
    return F.when(c != "", c)


def clean_hash(col: Column | str) -> Column:
    """A SHA-256 whatever its notation: ``sha256:`` prefix, separators, blanks and case don't count.

    Null when no 64 hexadecimal digits remain.
    """
    c = F.regexp_replace(F.lower(col), r"^\s*sha-?256\s*[:=]?|^\s*0x|[\s:\-]", "")
    return F.when(c.rlike("^[0-9a-f]{64}$"), c)


def clean_path(col: Column | str) -> Column:
    c = F.trim(col)
    return F.when(c != "", c)
