"""URL rules on Python strings, for use inside the HTML and Markdown kernels."""

from __future__ import annotations

import base64
import hashlib
import hmac
import html
import re

from papyrine.functions.space import trim

PROXY_PREFIX = "/proxy/"
LINK_SCHEMES = ("http", "https", "mailto", "tel")
IMAGE_SCHEMES = ("http", "https")

_NUMERIC = re.compile(r"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?")
_IGNORED = re.compile(r"[\x00-\x20\x7f]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*")
_BEFORE_COLON = re.compile(r"[^:/?#]*(?=:)")


def scalar(digits: str, base: int) -> str | None:
    """The character of a numeric reference, None beyond Unicode and for surrogates."""
    code = int(digits, base) if len(digits) < 12 else 1 << 32
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None


def decode_references(url: str) -> str:
    """Character references of a URL: the named and closed ones once, then numeric ones whose semicolon may be missing."""
    if "&" not in url:
        return url
    closed = re.sub(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", _closed, url)
    return _NUMERIC.sub(lambda m: (scalar(m[1], 16) if m[1] else scalar(m[2], 10)) or m[0], closed)


def _closed(m: re.Match) -> str:
    if m[0][1] == "#":
        return (scalar(m[0][3:-1], 16) if m[0][2] in "xX" else scalar(m[0][2:-1], 10)) or m[0]
    return html.entities.html5.get(m[0][1:], m[0])


def bare(url: str) -> str:
    """The URL as a browser reads its scheme: references decoded, white space and controls gone."""
    return _IGNORED.sub("", decode_references(url))


def has_dangerous_scheme(url: str) -> bool:
    """javascript:, data: or vbscript:, however disguised."""
    return bare(url)[:11].lower().startswith(("javascript:", "data:", "vbscript:"))


def is_safe(url: str, schemes: tuple[str, ...]) -> bool:
    """Relative, or of one of the schemes; nothing that a browser resolves against another host."""
    plain = bare(url)
    if not plain or plain.startswith(("//", "/\\", "\\")):
        return False
    m = _BEFORE_COLON.match(plain)
    if m is None:
        return True
    return _SCHEME.fullmatch(m[0]) is not None and m[0].lower() in schemes


def is_safe_link(url: str) -> bool:
    return is_safe(url, LINK_SCHEMES)


def is_safe_image(url: str) -> bool:
    return is_safe(url, IMAGE_SCHEMES)


def is_external_http(url: str) -> bool:
    return trim(url)[:8].lower().startswith(("http://", "https://"))


def is_relative(url: str) -> bool:
    plain = trim(url)
    return bool(plain) and not plain.startswith(("\\", "//", "/\\")) and ":" not in plain


def is_proxied(url: str, prefix: str) -> bool:
    return bool(prefix) and url.startswith(prefix)


def should_proxy(url: str, prefix: str) -> bool:
    plain = trim(url)
    return bool(plain) and not is_relative(plain) and not is_proxied(plain, prefix) and is_external_http(plain)


def usable_key(keys: tuple[str, ...]) -> bytes | None:
    """The first key that is hexadecimal; the empty key is one."""
    for k in keys:
        if re.fullmatch(r"(?:[0-9a-fA-F]{2})*", k):
            return bytes.fromhex(k)
    return None


def to_proxy(url: str, prefix: str, keys: tuple[str, ...] = ()) -> str:
    """prefix + unpadded URL-safe base64, with an HMAC-SHA256 of that path if a key is usable."""
    if not trim(url) or not prefix:
        return url
    path = prefix + base64.urlsafe_b64encode(trim(url).encode()).decode().rstrip("=")
    key = usable_key(tuple(keys))
    return path if key is None else f"{path}?sig={hmac.new(key, path.encode(), hashlib.sha256).hexdigest()}"
