"""Host names of URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute or scheme-relative URL, without user, port and leading ``www.``; '' if it names none, null for null."""
    authority = F.regexp_extract(F.trim(url), r"^(?i)(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\\]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(F.rtrim(bare), r"^www\.|\.$", "")
