"""A small HTML tree: tokenizer, tree building, selectors, serialisation.

It covers what documents need: void and raw-text elements, implied ends of p, li,
dt/dd, option and table parts, an implied tbody, misnested formatting elements,
foreign svg/math, unclosed elements at the end. Everything is iterative, so depth is
bounded by memory alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

from papyrine.functions.url_rules import scalar

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes plaintext".split())
#: Raw elements in whose text references are decoded.
DECODED_RAW = frozenset(("textarea", "title"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Elements whose start ends an open paragraph.
ENDS_PARAGRAPH = frozenset(
    (
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
        "h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre section summary table ul"
    ).split()
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_IMPLIED |= dict.fromkeys(("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot", "tr", "td", "th"))
#: Elements that implied ends do not cross.
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "optgroup": ("select",)}

_TAG = re.compile(
    r"<(?:(?P<comment>!--(?:-?>|.*?(?:--!?>|\Z)))|(?P<bogus>[!?][^>]*(?:>|\Z)|/[^A-Za-z>][^>]*(?:>|\Z)|/>)"
    r"|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+|[\"'])*+)>)",
    re.S,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_REOPENING = ENDS_PARAGRAPH | FORMATTING
_ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|([A-Za-z][A-Za-z0-9]*;?))")


class Node:
    """An element (``tag``), a text (``tag`` '#text') or a comment ('#comment')."""

    __slots__ = ("tag", "_attrs", "children", "parent", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | str | None = None, text: str = ""):
        self.tag, self._attrs, self.children, self.parent, self.text = tag, attrs, [], None, text

    @property
    def attrs(self) -> dict[str, str]:
        """Attributes in order; their source is read when they are first asked for."""
        if type(self._attrs) is not dict:
            self._attrs = attributes(self._attrs) if self._attrs else {}
        return self._attrs

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def walk(self) -> Iterator[Node]:
        """All nodes below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def elements(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag[0] != "#")

    def text_content(self) -> str:
        return "".join(n.text for n in self.walk() if n.tag == "#text")

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.elements() if n.tag == tag), None)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


def detach(nodes: list[Node]) -> None:
    """Detach nodes; the children of each parent are gone through once."""
    parents = {id(n.parent): n.parent for n in nodes if n.parent is not None}
    gone = {id(n) for n in nodes}
    for p in parents.values():
        p.children = [c for c in p.children if id(c) not in gone]
    for n in nodes:
        n.parent = None


def decode_text(text: str, attribute: bool = False) -> str:
    """References of a text or an attribute value, as the HTML standard reads them."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            code = scalar(m[1], 16) if m[1] else scalar(m[2], 10)
            return html.unescape(m[0] if m[0].endswith(";") else m[0] + ";") if code is not None else "�"
        if attribute and not m[3].endswith(";"):
            after = m.string[m.end() : m.end() + 1]
            return m[0] if after == "=" or m[3] not in html.entities.html5 else html.entities.html5[m[3]]
        return html.unescape(m[0])

    return _REFERENCE.sub(one, text)


def attributes(source: str) -> dict[str, str]:
    """Attributes in order, names in lower case, the first of a repeated one."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        out.setdefault(m[1].lower(), decode_text(value, attribute=True))
    return out


def parse(source: str, fragment: bool = True) -> Node:
    """The tree of a document. As a fragment, html, head and body tags are dropped and their content kept."""
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    root = Node("#root")
    stack = [root]
    where: dict[str, list[int]] = {}  # places of open elements in the stack by tag, so deep trees are never searched
    pieces: list[str] = []  # text not yet in the tree
    at, size = 0, len(source)

    def push(n: Node) -> None:
        where.setdefault(n.tag, []).append(len(stack))
        stack.append(n)

    def pop() -> Node:
        n = stack.pop()
        where[n.tag].pop()
        return n

    def cut(k: int) -> None:
        while len(stack) > k:
            pop()

    def text(value: str) -> None:
        if value:
            pieces.append(value)

    def settle() -> None:
        """Put the text read so far into the tree, as one node with a text before it."""
        if pieces:
            top, value = stack[-1], "".join(pieces)
            pieces.clear()
            if top.children and top.children[-1].tag == "#text":
                top.children[-1].text += value
            else:
                top.append(Node("#text", text=value))

    def nearest(tags: tuple[str, ...]) -> int:
        return max([w[-1] for t in tags if (w := where.get(t))], default=0)

    def close_to(tags: tuple[str, ...], scope: tuple[str, ...]) -> bool:
        """Close up to the nearest of the tags, if it is open inside the scope and its table."""
        k = nearest(tags)
        if not k or k < nearest(scope) or "table" not in tags and k < nearest(("table",)):
            return False
        cut(k)
        return True

    def end(tag: str) -> None:
        if not where.get(tag):
            if tag in ("p", "br"):
                stack[-1].append(Node(tag))
            return
        again = []
        while stack[-1].tag != tag:
            n = pop()
            if n.tag in FORMATTING and tag in _REOPENING:
                again.append(n)
        pop()
        for n in reversed(again):
            if n.children or tag in FORMATTING:
                push(stack[-1].append(Node(n.tag, dict(n.attrs))))

    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            text(decode_text(source[at:]))
            break
        m = _TAG.match(source, lt)
        if m is None:
            nxt = source.find("<", lt + 1)
            nxt = size if nxt < 0 else nxt
            after = source[lt + 1 : lt + 2]
            if after.isascii() and after.isalpha() or after == "/" and source[lt + 2 : lt + 3].isalpha():
                text(decode_text(source[at:lt]))  # a tag that never ends is lost with the rest
                break
            text(decode_text(source[at:nxt]))
            at = nxt
            continue
        if lt > at:
            text(decode_text(source[at:lt]))
        at = m.end()
        comment, bogus, closing, tag, attrs = m.groups()
        if bogus is not None:
            continue
        settle()
        if comment is not None:
            stack[-1].append(Node("#comment", text=re.sub(r"(--!?>|-?>)\Z", "", comment[3:])))
            continue
        tag = tag.lower()
        if tag in ("html", "head", "body"):
            if fragment:
                continue
            page = stack[1] if len(stack) > 1 and stack[1].tag == "html" else root
            if closing:
                if tag == "head":
                    cut(1 + (page is not root))
                continue
            held = root.find(tag) if tag == "html" else next((n for n in page.children if n.tag == tag), None)
            if held is None:
                cut(1 if tag == "html" else 1 + (page is not root))
                push(stack[-1].append(Node(tag, attrs)))
            else:
                for k, v in attributes(attrs).items():
                    held.attrs.setdefault(k, v)
            continue
        if closing:
            if tag in HEADINGS and not where.get(tag) and (k := nearest(HEADINGS)):
                tag = stack[k].tag
            end(tag)
            continue
        if tag in ENDS_PARAGRAPH:
            close_to(("p",), ("table", "td", "th", "button"))
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop()
        if tag in _IMPLIED:
            for _ in range(3):
                if not close_to(_IMPLIED[tag], _SCOPE.get(tag, ("table",))):
                    break
        if tag == "a" and where.get("a"):
            end("a")
        if tag == "tr" and stack[-1].tag == "table":
            push(stack[-1].append(Node("tbody")))
        node = stack[-1].append(Node(tag, attrs))
        foreign = where.get("svg") or where.get("math")
        if tag in VOID or (foreign and attrs.endswith("/")):
            continue
        if tag in RAW and not foreign:
            stop = _RAW_END[tag].search(source, at)
            inner = source[at : stop.start() if stop else size]
            if inner:
                node.append(Node("#text", text=decode_text(inner) if tag in DECODED_RAW else inner))
            at = stop.end() if stop else size
            continue
        push(node)
    settle()
    return root


def escape_text(text: str) -> str:
    return text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attribute(text: str) -> str:
    return text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")


def serialize(root: Node, own: bool = False) -> str:
    """HTML of what is below the node, and of the node itself if ``own``."""
    out: list[str] = []
    stack: list[Node | str] = [root] if own else list(reversed(root.children))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "#text":
            out.append(n.text if n.parent is not None and n.parent.tag in RAW - DECODED_RAW else escape_text(n.text))
        elif n.tag == "#comment":
            out.append(f"<!--{n.text}-->")
        else:
            attrs = "".join(f' {k}="{escape_attribute(v)}"' for k, v in n.attrs.items())
            out.append(f"<{n.tag}{attrs}>")
            if n.tag not in VOID:
                stack.append(f"</{n.tag}>")
                stack.extend(reversed(n.children))
    return "".join(out)


_COMPOUND = re.compile(r"\*|[A-Za-z][\w-]*|\.[\w-]+|#[\w-]+|\[\s*[\w:-]+\s*(?:[~|^$*]?=\s*(?:\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]|:(?:first-child|last-child)")
_ATTRIBUTE_TEST = re.compile(r"\[\s*([\w:-]+)\s*(?:([~|^$*]?)=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]")


def compile_selector(selector: str) -> Callable[[Node], bool] | None:
    """A test for nodes, for selectors of tags, classes, ids, attributes, descendants, children and lists; None if it is none of these."""
    tests = [_chain(part.strip()) for part in selector.split(",")] if selector.strip() else []
    if not tests or any(t is None for t in tests):
        return None
    return lambda n: any(t(n) for t in tests)


def _chain(text: str) -> Callable[[Node], bool] | None:
    parts = re.findall(r"(?:\[[^\]]*\]|[^\s>])+|>", text)
    steps: list[tuple[Callable[[Node], bool], bool]] = []
    child = False
    for p in parts:
        if p == ">":
            child = True
            continue
        pieces = _COMPOUND.findall(p)
        if not pieces or "".join(pieces) != p:
            return None
        simple = [_simple(x) for x in pieces]
        steps.append((lambda n, s=tuple(simple): all(f(n) for f in s), child))
        child = False
    if not steps or child:
        return None

    def test(n: Node) -> bool:
        def back(node: Node, k: int) -> bool:
            if not steps[k][0](node):
                return False
            if k == 0:
                return True
            up = node.parent
            while up is not None and up.tag[0] != "#":
                if back(up, k - 1):
                    return True
                if steps[k][1]:
                    return False
                up = up.parent
            return False

        return n.tag[0] != "#" and back(n, len(steps) - 1)

    return test


def _simple(x: str) -> Callable[[Node], bool]:
    if x == "*":
        return lambda n: True
    if x[0] == ".":
        return lambda n: x[1:] in n.classes()
    if x[0] == "#":
        return lambda n: n.attrs.get("id") == x[1:]
    if x[0] == ":":
        at = 0 if x == ":first-child" else -1
        return lambda n: n.parent is not None and [c for c in n.parent.children if c.tag[0] != "#"][at] is n
    if x[0] == "[":
        name, op, *values = _ATTRIBUTE_TEST.match(x).groups()
        name, value = name.lower(), next((v for v in values if v is not None), None)
        if value is None:
            return lambda n: name in n.attrs
        tests: dict[str, Callable[[str], bool]] = {
            "": lambda a: a == value,
            "~": lambda a: value in a.split(),
            "|": lambda a: a == value or a.startswith(value + "-"),
            "^": lambda a: bool(value) and a.startswith(value),
            "$": lambda a: bool(value) and a.endswith(value),
            "*": lambda a: bool(value) and value in a,
        }
        return lambda n: name in n.attrs and tests[op](n.attrs[name])
    return lambda n: n.tag == x.lower()


def select(root: Node, selectors: list[str]) -> list[Node]:
    """Nodes that any selector matches, in document order; a selector that cannot be read matches nothing."""
    tests = [t for s in selectors if s and (t := compile_selector(s)) is not None]
    return [n for n in root.elements() if any(t(n) for t in tests)] if tests else []
