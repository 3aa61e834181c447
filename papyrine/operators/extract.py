"""Content of HTML pages as Markdown, embedding text, and applying learned removals.

Rules of our own, where nothing is prescribed: selectors that cannot be read match
nothing; a listed HTML snippet removes every node whose outer HTML equals it after
collapsing white space; link texts and hrefs to remove match whole (trimmed) values,
rel tokens without case; the text-density filter drops blocks of more than
``LINK_SHARE`` link text. Null stays null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.urls import TRIM
from papyrine.operators import dom

SKIPPED = frozenset("script style noscript template iframe object embed svg math head canvas select textarea input button".split())
BLOCKS = dom.ENDS_PARAGRAPH | frozenset("body html tr td th tbody thead tfoot caption br".split())
#: Blocks with more of their text in links than this are dropped by the density filter.
LINK_SHARE = 0.6
#: Characters of text from which the density filter looks at a block.
DENSITY_LEAST = 25
RESULT = "struct<title string, meta map<string,string>, links map<string,string>, content string, canonical_url string, lang string>"


@dataclass(frozen=True)
class ConvertOptions:
    css_selectors_to_remove: tuple[str, ...] = ()
    content_selectors: tuple[str, ...] = ()
    link_text_content_to_remove: tuple[str, ...] = ()
    link_hrefs_to_remove: tuple[str, ...] = ()
    link_rel_tokens_to_remove: tuple[str, ...] = ()
    use_text_density_filter: bool = False


def collapse(text: str) -> str:
    return " ".join(text.split())


def outer_key(html: str) -> str:
    """Outer HTML of a snippet as compared: parsed, serialised, white space collapsed and none between tags."""
    return re.sub(r"\s*(<[^>]*>)\s*", r"\1", collapse(dom.serialize(dom.parse(html))))


def remove(root: dom.Node, selectors: list[str], snippets: list[str]) -> None:
    """Detach all nodes that a selector or a snippet names."""
    dom.detach(dom.select(root, selectors))
    wanted: dict[str, set[str]] = {}
    for s in snippets:
        if s and (first := dom.parse(s).children) and first[0].tag[0] != "#":
            wanted.setdefault(first[0].tag, set()).add(outer_key(s))
    if wanted:
        named = [n for n in root.elements() if n.tag in wanted]
        dom.detach([n for n in named if re.sub(r"\s*(<[^>]*>)\s*", r"\1", collapse(dom.serialize(n, own=True))) in wanted[n.tag]])


def apply_removals(html: str, selectors: list[str], snippets: list[str]) -> str:
    root = dom.parse(html, fragment=False)
    remove(root, selectors, snippets)
    return dom.serialize(root)


def markdown_of(root: dom.Node) -> str:
    """Markdown of a tree: headings, lists, quotes, code, tables, links, images, emphasis."""
    out: list[str] = []
    blocky, tabled, full, number = _flags(root)
    pending = ""
    prefix: list[str] = []
    bullet: list[str] = []
    pre = 0

    def flush(block: str | None = None) -> None:
        nonlocal pending
        text, pending = (pending if block is None else block), ""
        if not text.strip():
            return
        lines = [x.rstrip() if block is not None else x.strip() for x in text.strip("\n").split("\n")]
        mark = bullet.pop() if bullet else ""
        head = "".join(prefix)
        own = head[: len(head) - len(mark)] if mark and head.endswith(" " * len(mark)) else head
        out.append("\n".join(((own + mark) if k == 0 else head) + x for k, x in enumerate(lines)).rstrip())

    def inline(n: dom.Node) -> str:
        """Markdown of inline content."""
        text: list[str] = []
        stack: list[dom.Node | str] = [n]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                text.append(x)
            elif x.tag == "#text":
                text.append(re.sub(r"\s+", " ", x.text))
            elif x.tag == "br":
                text.append("\n")
            elif x.tag == "img":
                alt = collapse(x.attrs.get("alt", ""))
                if alt or x.attrs.get("src"):
                    text.append(f"![{alt}]({x.attrs.get('src', '').strip()})")
            elif x.tag in SKIPPED or x.tag == "#comment":
                continue
            else:
                marks = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "del": "~~", "s": "~~"}.get(x.tag, "")
                if x.tag == "a" and x.attrs.get("href"):
                    href = x.attrs["href"].strip().replace(" ", "%20").replace("(", "%28").replace(")", "%29")
                    text.append("[")
                    stack.append(f"]({href})")
                elif marks and id(x) in full:
                    text.append(marks)
                    stack.append(marks)
                stack.extend(reversed(x.children))
        return "".join(text)

    # (node, stage): 0 enter, 1 leave
    stack: list[tuple[dom.Node, int]] = [(root, 0)]
    while stack:
        n, stage = stack.pop()
        tag = n.tag
        if stage == 1:
            flush()
            if tag in ("ul", "ol", "menu") or tag == "blockquote":
                if tag == "blockquote":
                    prefix.pop()
            elif tag == "li":
                prefix.pop()
                if bullet:
                    bullet.pop()
            continue
        if tag in SKIPPED or tag == "#comment":
            continue
        if tag == "#text":
            pending += re.sub(r"\s+", " ", n.text)
        elif tag in dom.HEADINGS:
            flush()
            text = collapse(inline_children(n, inline))
            if text:
                flush("#" * int(tag[1]) + " " + text)
        elif tag == "pre":
            flush()
            code = n.text_content().strip("\n")
            if code.strip():
                fence = "```" if "```" not in code else "````"
                flush(f"{fence}\n{code}\n{fence}")
        elif tag == "table" and id(n) not in tabled:
            flush()
            rows = [[collapse(inline_children(c, inline)).replace("|", "\\|") for c in r.children if c.tag in ("td", "th")] for r in n.elements() if r.tag == "tr"]
            rows = [r for r in rows if any(r)]
            if rows:
                wide = max(map(len, rows))
                rows = [r + [""] * (wide - len(r)) for r in rows]
                flush("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * wide, *("| " + " | ".join(r) + " |" for r in rows[1:])]))
        elif tag == "hr":
            flush()
            flush("---")
        elif tag == "br":
            pending += "\n"
        elif tag in BLOCKS or tag == "#root":
            flush()
            if tag == "li":
                parent = n.parent.tag if n.parent is not None else "ul"
                mark = f"{number[id(n)]}. " if parent == "ol" else "- "
                prefix.append(" " * len(mark))
                bullet.append(mark)
            elif tag == "blockquote":
                prefix.append("> ")
            stack.append((n, 1))
            stack.extend((c, 0) for c in reversed(n.children))
        elif id(n) in blocky:
            stack.extend((c, 0) for c in reversed(n.children))
        else:
            pending += inline(n)
    flush()
    joined = ""
    for k, block in enumerate(out):
        listed = re.match(r"\s*(?:- |\d+\. )", block) is not None
        joined += ("" if k == 0 else "\n" if listed and re.match(r"\s*(?:- |\d+\. )", out[k - 1]) else "\n\n") + block
    return joined


def _flags(root: dom.Node) -> tuple[set[int], set[int], set[int], dict[int, int]]:
    """Nodes with blocks inside, with tables inside, with text; and the number of each item among its siblings: one walk for all."""
    blocky, tabled, full, number = set(), set(), set(), {}
    for n in reversed(list(root.walk())):
        up = n.parent
        if n.tag == "#text":
            if n.text.strip():
                full.add(id(up))
            continue
        if n.tag in BLOCKS or id(n) in blocky:
            blocky.add(id(up))
        if n.tag == "table" or id(n) in tabled:
            tabled.add(id(up))
        if id(n) in full:
            full.add(id(up))
    for n in (root, *root.elements()):
        items = 0
        for c in n.children:
            if c.tag == "li":
                number[id(c)] = items = items + 1
    return blocky, tabled, full, number


def inline_children(n: dom.Node, inline) -> str:
    return "".join(inline(c) for c in n.children)


def _prepare(root: dom.Node, o: ConvertOptions) -> None:
    remove(root, list(o.css_selectors_to_remove), [])
    texts, hrefs = {collapse(x) for x in o.link_text_content_to_remove if x}, {x.strip() for x in o.link_hrefs_to_remove if x}
    rels = {x.strip().lower() for x in o.link_rel_tokens_to_remove if x}
    if texts or hrefs or rels:
        named = [n for n in root.elements() if n.tag == "a"]
        dom.detach([a for a in named if collapse(a.text_content()) in texts or a.attrs.get("href", "").strip() in hrefs or rels & set(a.attrs.get("rel", "").lower().split())])
    if o.use_text_density_filter:
        total: dict[int, int] = {}
        linked: dict[int, int] = {}
        order = list(root.walk())
        for n in reversed(order):
            if n.tag == "#text":
                total[id(n)] = len(n.text.strip())
            else:
                total[id(n)] = sum(total[id(c)] for c in n.children)
                linked[id(n)] = total[id(n)] if n.tag == "a" else sum(linked.get(id(c), 0) for c in n.children)
        kept = (*dom.HEADINGS, "main", "article")
        dom.detach([n for n in order if n.tag in dom.ENDS_PARAGRAPH and n.tag not in kept and total[id(n)] >= DENSITY_LEAST and linked[id(n)] > LINK_SHARE * total[id(n)]])


def content_of(html: str, options: ConvertOptions = ConvertOptions()) -> dict:
    """Title, meta, links, canonical URL, language and Markdown content of a page."""
    root = dom.parse(html, fragment=False)
    title = meta_title = canonical = lang = None
    meta: dict[str, str] = {}
    links: dict[str, str] = {}
    for n in root.elements():
        if n.tag == "html" and lang is None:
            lang = n.attrs.get("lang") or None
        elif n.tag == "title" and title is None and not any(p.tag in ("svg", "math") for p in _up(n)):
            title = collapse(n.text_content()) or None
        elif n.tag == "meta":
            name = n.attrs.get("name") or n.attrs.get("property") or n.attrs.get("http-equiv")
            if name and "content" in n.attrs:
                meta.setdefault(name.lower(), n.attrs["content"])
                meta_title = meta_title or (n.attrs["content"] if name.lower() == "og:title" else None)
        elif n.tag == "link" and n.attrs.get("rel") and n.attrs.get("href"):
            for rel in n.attrs["rel"].lower().split():
                links.setdefault(rel, n.attrs["href"])
                if rel == "canonical" and canonical is None:
                    canonical = n.attrs["href"].strip() or None
    _prepare(root, options)
    roots = dom.select(root, list(options.content_selectors))
    inside = {id(n) for n in roots}
    outer = [n for n in roots if not any(id(p) in inside for p in _up(n))]
    content = "\n\n".join(x for x in map(markdown_of, outer) if x) if outer else markdown_of(root)
    return {"title": title or meta_title, "meta": meta, "links": links, "content": content, "canonical_url": canonical, "lang": lang}


def _up(n: dom.Node):
    while n.parent is not None:
        n = n.parent
        yield n


def _strings(x) -> tuple[str, ...]:
    return tuple(s for s in (x or ()) if s)


_ARROW_RESULT = pa.struct(
    [("title", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("links", pa.map_(pa.string(), pa.string())), ("content", pa.string()), ("canonical_url", pa.string()), ("lang", pa.string())]
)


def _row(html: str, o: ConvertOptions) -> dict:
    got = content_of(html, o)
    return got | {"meta": list(got["meta"].items()), "links": list(got["links"].items())}


def get_content_from_html(html: Column, options: ConvertOptions | Column = ConvertOptions()) -> Column:
    """``struct<title, meta, links, content, canonical_url, lang>``; options are one object for all rows or a struct Column per row."""
    if isinstance(options, ConvertOptions):

        @F.arrow_udf(RESULT)
        def run(v: pa.Array) -> pa.Array:
            return pa.array([None if x is None else _row(x, options) for x in v.to_pylist()], _ARROW_RESULT)

        return run(html)

    names = list(ConvertOptions.__dataclass_fields__)

    @F.arrow_udf(RESULT)
    def each(v: pa.Array, o: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(v.to_pylist(), o.to_pylist()):
            y = y or {}
            made = ConvertOptions(*[_strings(y.get(n)) for n in names[:-1]], bool(y.get(names[-1])))
            out.append(None if x is None else _row(x, made))
        return pa.array(out, _ARROW_RESULT)

    return each(html, options)


#: Images, links and reference definitions as they are collapsed, in this order; then white space at both ends.
COLLAPSING = (
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?md)^\[[^\]]+\]:[^\n]*\n?", ""),
    (TRIM, ""),
)


def collapse_markdown(c: Column) -> Column:
    """Images and links to their text, reference definitions gone: native."""
    for pattern, to in COLLAPSING:
        c = F.regexp_replace(c, pattern, to)
    return c


def html_to_embedding_text(html: Column) -> Column:
    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else markdown_of(dom.parse(x, fragment=False)) for x in v.to_pylist()], pa.string())

    return collapse_markdown(run(html))


def apply_dom_removals(html: Column, css_selectors: Column, snippets: Column) -> Column:
    """The page without the nodes named; null arrays remove nothing."""

    @F.arrow_udf("string")
    def run(v: pa.Array, s: pa.Array, h: pa.Array) -> pa.Array:
        out = [None if x is None else apply_removals(x, list(_strings(a)), list(_strings(b))) if a or b else x for x, a, b in zip(v.to_pylist(), s.to_pylist(), h.to_pylist())]
        return pa.array(out, pa.string())

    return run(html, css_selectors, snippets)


def with_removals(pages: DataFrame, removals: DataFrame, site: str = "site_id", html: str = "html") -> DataFrame:
    """Pages with ``cleaned_html``: an equi-join on the site, whose strategy (broadcast or shuffle) AQE takes from the measured size of the removals."""
    own = removals.select(F.col(site), F.col("css_selectors_to_remove").alias("__css"), F.col("html_to_remove").alias("__html"))
    return pages.join(own, site, "left").withColumn("cleaned_html", apply_dom_removals(F.col(html), F.col("__css"), F.col("__html"))).drop("__css", "__html")


