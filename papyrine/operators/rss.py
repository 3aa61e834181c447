"""Sanitising feed HTML: allowlist, fixed link and image attributes, first image, image proxy, empty containers."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.url_rules import LINK_SCHEMES, PROXY_PREFIX, bare, has_dangerous_scheme, should_proxy, to_proxy
from papyrine.operators import dom

#: Elements dropped with all they hold.
DROPPED = frozenset("iframe form input button select textarea object embed base svg math meta script style".split())
#: Elements removed when they hold nothing but white space.
CONTAINERS = frozenset("article aside div details footer figure figcaption header main nav p span section summary".split())
#: Elements kept; any other gives way to its content.
ALLOWED = CONTAINERS | frozenset("a strong em b i u s del h1 h2 h3 h4 h5 h6 ul ol li blockquote pre code table thead tbody tr th td img br hr sup sub dl dt dd".split())
ATTRIBUTES = {"a": ("href", "title"), "img": ("src", "alt", "title")}
FORCED = {"a": (("rel", "nofollow noopener"), ("target", "_blank")), "img": (("loading", "lazy"), ("fetchpriority", "low"), ("decoding", "async"))}
SCHEMA = "struct<html string, first_image_src string>"

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")


@dataclass(frozen=True)
class RssOptions:
    proxy_images: bool = False
    image_proxy_url_prefix: str = PROXY_PREFIX
    image_proxy_signing_keys: tuple[str, ...] = ()


def _url_allowed(url: str) -> bool:
    if has_dangerous_scheme(url):
        return False
    m = _SCHEME.match(bare(url))
    return m is None or m[1].lower() in LINK_SCHEMES


def sanitize(source: str, options: RssOptions = RssOptions()) -> tuple[str, str | None]:
    """The clean fragment, and the source of its first external image as written."""
    if not source:
        return "", None
    root, first = dom.Node("#root"), None
    stack = [(c, root) for c in reversed(dom.parse(source).children)]
    while stack:
        n, into = stack.pop()
        if n.tag == "#text":
            if into.children and into.children[-1].tag == "#text":
                into.children[-1].text += n.text
            else:
                into.append(dom.Node("#text", text=n.text))
            continue
        if n.tag == "#comment" or n.tag in DROPPED:
            continue
        if n.tag in ALLOWED:
            attrs = {}
            for name, value in n.attrs.items():
                if name not in ATTRIBUTES.get(n.tag, ()) or name in ("href", "src") and not _url_allowed(value):
                    continue
                if name == "src" and should_proxy(value, options.image_proxy_url_prefix):
                    first = value if first is None else first
                    if options.proxy_images:
                        value = to_proxy(value, options.image_proxy_url_prefix, options.image_proxy_signing_keys)
                attrs[name] = value
            attrs.update(FORCED.get(n.tag, ()))
            into = into.append(dom.Node(n.tag, attrs))
        stack.extend((c, into) for c in reversed(n.children))
    drop_empty(root)
    return dom.serialize(root), first


def has_empty_container(source: str) -> bool:
    """Whether a closed container of the source holds nothing but white space."""
    return any(n.tag in CONTAINERS and _empty(n) for n in dom.parse(source).elements())


def _empty(n: dom.Node) -> bool:
    return all(c.tag == "#text" and not c.text.strip() for c in n.children)


def drop_empty(root: dom.Node) -> None:
    """Empty containers, innermost first, so that nested ones go together."""
    for n in reversed(list(root.elements())):
        if n.tag in CONTAINERS and _empty(n):
            n.detach()


def has_empty_containers(html: Column) -> Column:
    """``has_empty_container`` of each row; null stays null. Sources without a container's tag never reach Python."""

    @F.arrow_udf("boolean")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else has_empty_container(x) for x in v.to_pylist()], pa.bool_())

    named = html.rlike("(?i)<(?:" + "|".join(sorted(CONTAINERS)) + r")[\s/>]")
    return F.when(html.isNotNull(), F.coalesce(run(F.when(named, html)), F.lit(False)))


def sanitize_rss_html(html: Column, options: RssOptions = RssOptions()) -> Column:
    """``struct<html, first_image_src>``; null stays null, '' gives '' and no image."""

    @F.arrow_udf(SCHEMA)
    def run(v: pa.Array) -> pa.Array:
        out = [None if x is None else dict(zip(("html", "first_image_src"), sanitize(x, options))) for x in v.to_pylist()]
        return pa.array(out, pa.struct([("html", pa.string()), ("first_image_src", pa.string())]))

    return run(html)
