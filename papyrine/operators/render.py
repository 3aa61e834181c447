"""Markdown to HTML with a URL policy, and sanitising of HTML written by administrators."""

from __future__ import annotations

import urllib.parse
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.space import trim
from papyrine.functions.url_rules import PROXY_PREFIX, is_external_http, is_safe_image, is_safe_link, should_proxy, to_proxy
from papyrine.operators import dom
from papyrine.operators.markdown import Md, parse

#: Elements administrators may use.
ADMIN_TAGS = frozenset(
    "p br a strong em b i u s del h1 h2 h3 h4 h5 h6 ul ol li blockquote pre code table thead tbody tr th td img hr figure figcaption details summary sup sub span div dl dt dd".split()
)
#: Elements dropped with all they hold.
ADMIN_DROPPED = frozenset("script style iframe object embed form input button select textarea meta base svg".split())
ADMIN_VOID = frozenset(("br", "hr", "img"))
ADMIN_ATTRIBUTES = {"a": ("href", "title"), "img": ("src", "alt", "title", "width", "height")}
ADMIN_GLOBAL = ("class", "id")

_HREF_SAFE = "-_.+!*(),%#@?=;:/&$~"


@dataclass(frozen=True)
class RenderOptions:
    allow_html: bool = False
    nofollow_links: bool = True
    proxy_images: bool = True
    image_proxy_url_prefix: str = PROXY_PREFIX
    image_proxy_signing_keys: tuple[str, ...] = ()

    def rel(self) -> str:
        return "nofollow ugc noopener" if self.nofollow_links else "noopener"

    def source(self, url: str) -> str:
        """An image URL as written into the page."""
        if self.proxy_images and should_proxy(url, self.image_proxy_url_prefix):
            return to_proxy(url, self.image_proxy_url_prefix, self.image_proxy_signing_keys)
        return url


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def escape_href(url: str) -> str:
    return urllib.parse.quote(url, safe=_HREF_SAFE + "'").replace("&", "&amp;").replace("'", "&#x27;")


_WRAPS = {"emph": "em", "strong": "strong", "strike": "del"}


def html_of(root: Md, o: RenderOptions) -> str:
    """HTML of a tree; newlines inside paragraphs are hard breaks."""
    out: list[str] = []
    stack: list[Md | str] = [root]

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    def push(open_: str, children: list, close: str) -> None:
        out.append(open_)
        stack.append(close)
        stack.extend(reversed(children))

    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if n.startswith("\n") and out and out[-1].endswith("\n"):
                n = n[1:]
            out.append(n)
            continue
        kind = n.kind
        if kind == "document":
            stack.extend(reversed(n.children))
        elif kind == "text":
            out.append(escape(n.text))
        elif kind in ("soft", "hard"):
            out.append("<br />\n")
        elif kind == "code":
            out.append(f"<code>{escape(n.text)}</code>")
        elif kind == "html":
            out.append(n.text if o.allow_html else escape(n.text))
        elif kind in _WRAPS:
            push(f"<{_WRAPS[kind]}>", n.children, f"</{_WRAPS[kind]}>")
        elif kind == "link":
            url = n.url if is_safe_link(n.url) else ""
            attrs = (f' href="{escape_href(url)}"' if url else "") + (f' title="{escape(n.title)}"' if n.title else "")
            push(f"<a{attrs}{f' rel="{o.rel()}" target="_blank"' if is_external_http(url) else ''}>", n.children, "</a>")
        elif kind == "image":
            url = n.url if is_safe_image(n.url) else ""
            src = f' src="{escape_href(o.source(url))}"' if url else ""
            out.append(f'<img{src} alt="{escape(n.plain())}"{f' title="{escape(n.title)}"' if n.title else ''} />')
        elif kind == "paragraph":
            line()
            push("<p>", n.children, "</p>\n")
        elif kind == "tight":
            stack.extend(reversed(n.children))
        elif kind == "heading":
            line()
            push(f"<h{n.level}>", n.children, f"</h{n.level}>\n")
        elif kind == "code_block":
            line()
            lang = n.info.split()[0] if n.info.split() else ""
            out.append(f"<pre><code{f' class="language-{escape(lang)}"' if lang else ''}>{escape(n.text)}</code></pre>\n")
        elif kind == "rule":
            line()
            out.append("<hr />\n")
        elif kind == "html_block":
            line()
            out.append(n.text if o.allow_html else escape(n.text))
        elif kind == "quote":
            line()
            push("<blockquote>\n", n.children, "</blockquote>\n")
        elif kind == "list":
            line()
            tag = "ul" if n.start is None else "ol"
            first = f' start="{n.start}"' if n.start not in (None, 1) else ""
            if n.tight:
                for item in n.children:
                    item.children = [_tight(c) for c in item.children]
            push(f"<{tag}{first}>\n", n.children, f"</{tag}>\n")
        elif kind == "item":
            push("<li>", n.children, "</li>\n")
        elif kind == "table":
            line()
            rows: list[Md | str] = ["<thead>\n", *_row(n.children[0], "th", n.align), "</thead>\n"]
            if len(n.children) > 1:
                rows += ["<tbody>\n", *[x for r in n.children[1:] for x in _row(r, "td", n.align)], "</tbody>\n"]
            push("<table>\n", rows, "</table>\n")
        elif kind == "cell":
            push("", n.children, "")
    return "".join(out)


def _tight(n: Md) -> Md:
    if n.kind != "paragraph":
        return n
    flat = Md("tight")
    flat.children = n.children
    return flat


def _row(row: Md, tag: str, align: tuple[str, ...]) -> list[Md | str]:
    out: list[Md | str] = ["<tr>\n"]
    for cell, side in zip(row.children, align):
        out += [f"<{tag}{f' align="{side}"' if side else ''}>", cell, f"</{tag}>\n"]
    return [*out, "</tr>\n"]


def sanitize_admin(html: str, o: RenderOptions = RenderOptions(nofollow_links=False, proxy_images=False)) -> str:
    """HTML of the elements and attributes administrators may use; others give way to their content or go with it."""
    if not html:
        return ""
    out: list[str] = []
    stack: list[dom.Node | str] = list(reversed(dom.parse(html).children))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "#text":
            out.append(n.text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif n.tag == "#comment" or n.tag in ADMIN_DROPPED:
            continue
        elif n.tag not in ADMIN_TAGS:
            stack.extend(reversed(n.children))
        else:
            out.append(_admin_tag(n, o))
            if n.tag not in ADMIN_VOID:
                stack.append(f"</{n.tag}>")
                stack.extend(reversed(n.children))
    return "".join(out)


def _admin_tag(n: dom.Node, o: RenderOptions) -> str:
    parts, external = [n.tag], False
    for name, value in n.attrs.items():
        if name not in ADMIN_GLOBAL and name not in ADMIN_ATTRIBUTES.get(n.tag, ()):
            continue
        if name == "href" and not is_safe_link(value) or name == "src" and not is_safe_image(value):
            continue
        external = external or name == "href" and is_external_http(value)
        value = o.source(value) if n.tag == "img" and name == "src" else value
        parts.append(f'{name}="{value.replace("&", "&amp;").replace(chr(34), "&quot;").replace("<", "&lt;")}"')
    if external:
        parts += [f'rel="{o.rel()}"', 'target="_blank"']
    return f"<{' '.join(parts)}>"


def render(text: str, o: RenderOptions = RenderOptions()) -> str:
    html = html_of(parse(text), o)
    return trim(sanitize_admin(html, o) if o.allow_html else html)


def render_markdown_to_html(text: Column, options: RenderOptions = RenderOptions()) -> Column:
    """HTML of Markdown; null stays null."""

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else render(x, options) for x in v.to_pylist()], pa.string())

    return run(text)


def sanitize_admin_html(html: Column, options: RenderOptions = RenderOptions(nofollow_links=False, proxy_images=False)) -> Column:
    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else sanitize_admin(x, options) for x in v.to_pylist()], pa.string())

    return run(html)
