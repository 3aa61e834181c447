"""URL predicates and image-proxy rewriting as native Column expressions.

They agree with ``url_rules``. Where a URL may hold character references (an ``&``),
only the scheme predicates need Python, and only those rows reach it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions import url_rules
from papyrine.functions.url_rules import IMAGE_SCHEMES, LINK_SCHEMES, PROXY_PREFIX

TRIM = r"(?U)^\s+|(?<!\s)\s+\z"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, TRIM, "")


def is_external_http(url: Column) -> Column:
    return trimmed(url).rlike(r"^(?i)https?://")


def is_relative(url: Column) -> Column:
    return trimmed(url).rlike(r"^(?!\\|//|/\\)[^:]+\z")


def is_proxied(url: Column, prefix: str) -> Column:
    return url.startswith(prefix) if prefix else F.lit(False) & url.isNotNull()


def should_proxy(url: Column, prefix: str = PROXY_PREFIX) -> Column:
    plain = trimmed(url)
    return (plain != "") & ~is_relative(plain) & ~is_proxied(plain, prefix) & is_external_http(plain)


def decoded(url: Column) -> Column:
    """Character references decoded; rows without ``&`` never leave the JVM as payload."""

    @F.arrow_udf("string")
    def references(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else url_rules.decode_references(x) for x in v.to_pylist()], pa.string())

    return F.coalesce(references(F.when(url.contains("&"), url)), url)


def _bare(url: Column, references: bool) -> Column:
    return F.regexp_replace(decoded(url) if references else url, r"[\x00-\x20\x7F]", "")


def has_dangerous_scheme(url: Column, references: bool = True) -> Column:
    """``references=False`` keeps the expression native, for URLs known to hold none."""
    return _bare(url, references).rlike(r"^(?i)(?:javascript|data|vbscript):")


def is_safe(url: Column, schemes: tuple[str, ...], references: bool = True) -> Column:
    """A relative URL or one of the schemes, never one of another host by slashes alone."""
    names = "|".join(schemes)
    return _bare(url, references).rlike(rf"(?s)^(?!//|/\\|\\)(?:(?i:{names}):.*|[^:/?#]+(?:[/?#].*)?|[/?#].*)\z")


def is_safe_link(url: Column, references: bool = True) -> Column:
    return is_safe(url, LINK_SCHEMES, references)


def is_safe_image(url: Column, references: bool = True) -> Column:
    return is_safe(url, IMAGE_SCHEMES, references)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC from nested SHA-256, so signing stays in code generation."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def to_proxy(url: Column, prefix: str = PROXY_PREFIX, keys: tuple[str, ...] = ()) -> Column:
    """The proxied form of a URL; blank URLs and an empty prefix leave it as it is."""
    if not prefix:
        return url
    encoded = F.translate(F.base64(F.encode(trimmed(url), "UTF-8")), "+/=\r\n", "-_")
    path = F.concat(F.lit(prefix), encoded)
    key = url_rules.usable_key(tuple(keys))
    whole = path if key is None else F.concat(path, F.lit("?sig="), hmac_sha256(key, path))
    return F.when(trimmed(url) == "", url).otherwise(whole)
