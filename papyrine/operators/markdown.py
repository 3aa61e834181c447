"""A Markdown tree: CommonMark blocks and inlines, with tables, strikethrough and bare autolinks as options."""

from __future__ import annotations

import html
import re
import unicodedata

#: Nesting beyond this is read as text, so hostile input cannot exhaust the stack.
DEEPEST = 60

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*(.*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|[ \t]*$)")
_TABLE_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<([^<>\n]*)>|(\S+))(?:[ \t]*\n?[ \t]+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)))?[ \t]*(?:\n|\Z)")
#: Elements that begin an HTML block up to a blank line.
_HTML_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option "
    "p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
_HTML_STARTS = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?=[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{'|'.join(_HTML_BLOCK_TAGS)})(?=[\s/>]|$)", re.I), None),
)
_OPEN_TAG = r"<[A-Za-z][A-Za-z0-9-]*+(?:\s++[A-Za-z_:][\w.:-]*+(?:\s*+=\s*+(?:[^\s\"'=<>`]++|'[^']*+'|\"[^\"]*+\"))?+)*+\s*+/?>"
_CLOSE_TAG = r"</[A-Za-z][A-Za-z0-9-]*+\s*+>"
_HTML_LINE = re.compile(rf" {{0,3}}(?:{_OPEN_TAG}|{_CLOSE_TAG})[ \t]*$")
_RAW_HTML = re.compile(rf"{_OPEN_TAG}|{_CLOSE_TAG}|<!--(?:>|->|.*?-->)|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
_MAIL_LINK = re.compile(r"<([a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*)>")
_REFERENCE = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_PLAIN = re.compile(r"[^\\`*_~!\[\]<&\n]+")
_BARE_URL = re.compile(r"(?:(?<![A-Za-z0-9])(?:https?|ftp)://|(?:(?<=[\s*_~(\[])|^)www\.)[^\s<]+|[A-Za-z0-9.+_-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+", re.I)


class Md:
    """A node: ``kind``, children, and whatever the kind needs."""

    __slots__ = ("kind", "children", "text", "url", "title", "level", "info", "tight", "start", "align", "next", "prev")

    def __init__(self, kind: str, text: str = "", **more):
        self.kind, self.text, self.children = kind, text, []
        self.url = self.title = self.info = ""
        self.level, self.tight, self.start, self.align, self.next, self.prev = 0, True, None, (), None, None
        for k, v in more.items():
            setattr(self, k, v)

    def walk(self):
        """The node and all below, in order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def plain(self) -> str:
        return "".join(" " if n.kind in ("soft", "hard") else n.text for n in self.walk() if n.kind in ("text", "code", "soft", "hard"))


def unescape(text: str) -> str:
    """Backslash escapes and references of URLs, titles and info strings."""
    if "&" in text:
        text = _REFERENCE.sub(lambda m: html.unescape(m[0]), text)
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


class Chain:
    """Inline nodes as a linked list, so that wrapping a run of them costs no copying."""

    def __init__(self) -> None:
        self.head = self.tail = Md("head")

    def add(self, node: Md) -> Md:
        self.tail.next, node.prev = node, self.tail
        self.tail = node
        return node


class Parser:
    """One document."""

    def __init__(self, tables: bool = True, strikethrough: bool = True, autolink: bool = True):
        self.tables, self.strikethrough, self.autolink = tables, strikethrough, autolink
        self.refs: dict[str, tuple[str, str]] = {}
        self.leaves: list[tuple[Md, str]] = []

    def parse(self, text: str) -> Md:
        text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "\ufffd")
        lines = [self.expand(x) if "\t" in x else x for x in text.split("\n")]
        root = Md("document")
        root.children = self.blocks(lines, 0)
        for node, source in self.leaves:
            node.children = self.inlines(source)
        return root

    @staticmethod
    def expand(line: str) -> str:
        """Leading tabs as columns; tabs inside stay."""
        bare = line.lstrip(" \t")
        return line[: len(line) - len(bare)].expandtabs(4) + bare

    def leaf(self, kind: str, source: str, **more) -> Md:
        node = Md(kind, **more)
        self.leaves.append((node, source))
        return node

    # blocks

    def blocks(self, lines: list[str], depth: int) -> list[Md]:
        out: list[Md] = []
        i, n = 0, len(lines)
        while i < n:
            line = lines[i]
            if not line.strip():
                i += 1
                continue
            indent = _indent(line)
            if indent >= 4:
                j = i
                while j < n and (_indent(lines[j]) >= 4 or not lines[j].strip()):
                    j += 1
                code = [x[4:] for x in lines[i:j]]
                while code and not code[-1].strip():
                    code.pop()
                out.append(Md("code_block", "\n".join(code) + "\n"))
                i = j
                continue
            if m := _FENCE.match(line):
                if not (m[2][0] == "`" and "`" in m[3]):
                    i = self.fence(lines, i, m, out)
                    continue
            if m := _ATX.match(line):
                out.append(self.leaf("heading", (m[2] or "").strip(), level=len(m[1])))
                i += 1
                continue
            if _RULE.match(line):
                out.append(Md("rule"))
                i += 1
                continue
            if line[indent] == ">" and depth < DEEPEST:
                i = self.quote(lines, i, depth, out)
                continue
            if (m := _ITEM.match(line)) and depth < DEEPEST:
                i = self.list(lines, i, depth, out)
                continue
            if line[indent] == "<" and (end := self.html_end(lines, i)) is not None:
                out.append(Md("html_block", "\n".join(lines[i:end]) + "\n"))
                i = end
                continue
            if self.tables and "|" in line and i + 1 < n and _TABLE_RULE.match(lines[i + 1]) and (end := self.table(lines, i, out)):
                i = end
                continue
            i = self.paragraph(lines, i, out)
        return out

    def fence(self, lines: list[str], i: int, m: re.Match, out: list[Md]) -> int:
        pad, mark, info = len(m[1]), m[2], m[3].strip()
        close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
        body, j = [], i + 1
        while j < len(lines) and not close.match(lines[j]):
            body.append(lines[j][min(pad, _indent(lines[j])) :])
            j += 1
        out.append(Md("code_block", "".join(x + "\n" for x in body), info=unescape(info), level=1))
        return min(j + 1, len(lines))

    def starts_block(self, line: str) -> bool:
        """Whether the line may interrupt a paragraph."""
        if _indent(line) >= 4:
            return False
        m = _ITEM.match(line)
        if m and (m[4] or "").strip() and (m[2] in "-+*" or m[2][:-1] == "1"):
            return True
        f = _FENCE.match(line)
        if f and not (f[2][0] == "`" and "`" in f[3]):
            return True
        return bool(_ATX.match(line) or _RULE.match(line) or _QUOTE.match(line) or any(s.match(line) for s, _ in _HTML_STARTS))

    def quote(self, lines: list[str], i: int, depth: int, out: list[Md]) -> int:
        inner: list[str] = []
        while i < len(lines):
            m = _QUOTE.match(lines[i])
            if m:
                inner.append(lines[i][m.end() :])
            elif lines[i].strip() and inner and inner[-1].strip() and self.lazy(inner) and not self.starts_block(lines[i]):
                inner.append(lines[i].lstrip())
            else:
                break
            i += 1
        node = Md("quote")
        node.children = self.blocks(inner, depth + 1)
        out.append(node)
        return i

    def lazy(self, inner: list[str]) -> bool:
        """Whether the last line is paragraph text that a following line may continue."""
        last = inner[-1]
        while (m := _QUOTE.match(last)) or (m := _ITEM.match(last)):
            last = last[m.end() :] if m.re is _QUOTE else (m[4] or "")
            if not last.strip():
                return False
        return _indent(last) < 4 and not (_ATX.match(last) or _RULE.match(last) or _FENCE.match(last))

    def list(self, lines: list[str], i: int, depth: int, out: list[Md]) -> int:
        first = _ITEM.match(lines[i])
        kind = first[2][-1]
        node = Md("list", start=int(first[2][:-1]) if first[2][0].isdigit() else None)
        loose = False
        while i < len(lines):
            m = _ITEM.match(lines[i])
            if not m or m[2][-1] != kind or _RULE.match(lines[i]):
                break
            gap = len(m[3] or "")
            rest = (m[4] or "") if m[3] is not None else ""
            if not rest.strip():
                width, body = len(m[1]) + len(m[2]) + 1, [""]
            elif gap > 4:
                width, body = len(m[1]) + len(m[2]) + 1, [" " * (gap - 1) + rest]
            else:
                width, body = len(m[1]) + len(m[2]) + gap, [rest]
            i += 1
            blank = not rest.strip()
            if blank and i < len(lines) and not lines[i].strip():
                pass  # an item that begins with a blank line ends at the next one
            else:
                while i < len(lines):
                    line = lines[i]
                    if not line.strip():
                        body.append("")
                        i += 1
                        continue
                    if _indent(line) >= width:
                        body.append(line[width:])
                    elif body and body[-1].strip() and self.lazy(body) and not self.starts_block(line) and not _ITEM.match(line):
                        body.append(line.lstrip())
                    else:
                        break
                    i += 1
            trailing = 0
            while body and not body[-1].strip():
                body.pop()
                trailing += 1
            item = Md("item")
            item.children = self.blocks(body, depth + 1)
            node.children.append(item)
            following = i < len(lines) and (f := _ITEM.match(lines[i])) is not None and f[2][-1] == kind
            if trailing and following or self.has_gap(body, item):
                loose = True
        node.tight = not loose
        out.append(node)
        return i

    @staticmethod
    def has_gap(body: list[str], item: Md) -> bool:
        """Whether blank lines part the item's own blocks."""
        if len(item.children) < 2:
            return False
        fenced = False
        for k, line in enumerate(body[:-1]):
            if _FENCE.match(line):
                fenced = not fenced
            if not fenced and not line.strip() and body[k + 1].strip() and _indent(body[k + 1]) < 2:
                return True
        return False

    def html_end(self, lines: list[str], i: int) -> int | None:
        """The line after the HTML block that begins here."""
        for start, end in _HTML_STARTS:
            if start.match(lines[i]):
                j = i
                if end is None:
                    while j < len(lines) and lines[j].strip():
                        j += 1
                    return j
                while j < len(lines) and not end.search(lines[j]):
                    j += 1
                return min(j + 1, len(lines))
        if _HTML_LINE.match(lines[i]):
            j = i
            while j < len(lines) and lines[j].strip():
                j += 1
            return j
        return None

    @staticmethod
    def cells(line: str) -> list[str]:
        row = line.strip()
        row = row[1:] if row.startswith("|") else row
        parts = re.split(r"(?<!\\)\|", row)
        if len(parts) > 1 and not parts[-1].strip():
            parts.pop()
        return [p.strip().replace("\\|", "|") for p in parts]

    def table(self, lines: list[str], i: int, out: list[Md]) -> int | None:
        head, rule = self.cells(lines[i]), self.cells(lines[i + 1])
        if len(head) != len(rule):
            return None
        node = Md("table", align=tuple("center" if r.startswith(":") and r.endswith(":") else "left" if r.startswith(":") else "right" if r.endswith(":") else "" for r in rule))
        j = i + 2
        rows = [head]
        while j < len(lines) and lines[j].strip() and not self.starts_block(lines[j]):
            rows.append((self.cells(lines[j]) + [""] * len(head))[: len(head)])
            j += 1
        for r in rows:
            row = Md("row")
            row.children = [self.leaf("cell", c) for c in r]
            node.children.append(row)
        out.append(node)
        return j

    def paragraph(self, lines: list[str], i: int, out: list[Md]) -> int:
        own = [lines[i].strip()]
        j, level = i + 1, 0
        while j < len(lines) and lines[j].strip():
            if m := _SETEXT.match(lines[j]):
                level = 1 if m[1][0] == "=" else 2
                break
            if self.starts_block(lines[j]) or (self.tables and "|" in lines[j] and j + 1 < len(lines) and _TABLE_RULE.match(lines[j + 1]) and len(self.cells(lines[j])) == len(self.cells(lines[j + 1]))):
                break
            own.append(lines[j].lstrip())
            j += 1
        text = "\n".join(own)
        while text.startswith("[") and (m := _DEFINITION.match(text)):
            label = _label(m[1])
            if not label:
                break
            self.refs.setdefault(label, (unescape(m[2] if m[2] is not None else m[3]), unescape(next((g for g in m.groups()[3:] if g is not None), ""))))
            text = text[m.end() :]
        if not text.strip():
            return j if not level else self.rest_of_setext(lines, j, out)
        out.append(self.leaf("heading", text.strip(), level=level) if level else self.leaf("paragraph", text.rstrip()))
        return j + 1 if level else j

    def rest_of_setext(self, lines: list[str], j: int, out: list[Md]) -> int:
        if _RULE.match(lines[j]):
            out.append(Md("rule"))
        else:
            out.append(self.leaf("paragraph", lines[j].strip()))
        return j + 1

    # inlines

    def inlines(self, s: str) -> list[Md]:
        chain = Chain()
        add = chain.add
        delims: list[list] = []  # node, sign, count, opens, closes, original count
        brackets: list[list] = []  # node, place, image, active, delimiters before
        no_code: set[int] = set()
        pos, n = 0, len(s)

        def word(text: str) -> None:
            tail = chain.tail
            if tail.kind == "text" and not (delims and delims[-1][0] is tail) and not (brackets and brackets[-1][0] is tail):
                tail.text += text
            else:
                add(Md("text", text))

        while pos < n:
            c = s[pos]
            if m := _PLAIN.match(s, pos):
                word(m[0])
                pos = m.end()
            elif c == "\n":
                tail = chain.tail
                hard = tail.kind == "text" and tail.text.endswith("  ")
                if tail.kind == "text":
                    tail.text = tail.text.rstrip(" ")
                add(Md("hard" if hard else "soft"))
                pos += 1
                while pos < n and s[pos] == " ":
                    pos += 1
            elif c == "\\":
                if s[pos + 1 : pos + 2] == "\n":
                    add(Md("hard"))
                    pos += 2
                elif m := _ESCAPE.match(s, pos):
                    word(m[1])
                    pos = m.end()
                else:
                    word("\\")
                    pos += 1
            elif c == "`":
                m = re.compile("`+").match(s, pos)
                size = len(m[0])
                end = -1
                if size not in no_code:
                    at = m.end()
                    while (at := s.find("`", at)) >= 0:
                        r = re.compile("`+").match(s, at)
                        if len(r[0]) == size:
                            end = at
                            break
                        at = r.end()
                    else:
                        no_code.add(size)
                if end < 0:
                    word(m[0])
                    pos = m.end()
                else:
                    code = s[m.end() : end].replace("\n", " ")
                    add(Md("code", code[1:-1] if code.strip(" ") and code[0] == code[-1] == " " and len(code) > 1 else code))
                    pos = end + size
            elif c in "*_~":
                m = re.compile(re.escape(c) + "+").match(s, pos)
                count = len(m[0])
                if c == "~" and (not self.strikethrough or count > 2):
                    word(m[0])
                    pos = m.end()
                    continue
                before, after = s[pos - 1] if pos else "\n", s[m.end()] if m.end() < n else "\n"
                left = not after.isspace() and (not self.sign(after) or before.isspace() or self.sign(before))
                right = not before.isspace() and (not self.sign(before) or after.isspace() or self.sign(after))
                opens = left and (c != "_" or not right or self.sign(before))
                closes = right and (c != "_" or not left or self.sign(after))
                node = add(Md("text", m[0]))
                delims.append([node, c, count, opens, closes, count])
                pos = m.end()
            elif c == "!" and s[pos + 1 : pos + 2] == "[":
                brackets.append([add(Md("text", "![")), pos + 2, True, True, len(delims)])
                pos += 2
            elif c == "[":
                brackets.append([add(Md("text", "[")), pos + 1, False, True, len(delims)])
                pos += 1
            elif c == "]":
                pos = self.close_bracket(s, pos, brackets, delims, chain, word)
            elif c == "<":
                if m := _AUTOLINK.match(s, pos):
                    link = add(Md("link", url=m[1]))
                    link.children = [Md("text", m[1])]
                    pos = m.end()
                elif m := _MAIL_LINK.match(s, pos):
                    link = add(Md("link", url="mailto:" + m[1]))
                    link.children = [Md("text", m[1])]
                    pos = m.end()
                elif m := _RAW_HTML.match(s, pos):
                    add(Md("html", m[0]))
                    pos = m.end()
                else:
                    word("<")
                    pos += 1
            elif c == "&" and (m := _REFERENCE.match(s, pos)) and (plain := html.unescape(m[0])) != m[0]:
                word(plain)
                pos = m.end()
            else:
                word(c)
                pos += 1
        self.emphasis(delims, 0)
        return self.linked(self.collect(chain.head))

    @staticmethod
    def sign(c: str) -> bool:
        return unicodedata.category(c)[0] in "PS"

    @staticmethod
    def collect(head: Md) -> list[Md]:
        out, node = [], head.next
        while node is not None:
            if node.kind != "text" or node.text:
                if out and node.kind == "text" and out[-1].kind == "text":
                    out[-1].text += node.text
                else:
                    out.append(node)
            node = node.next
        return out

    def close_bracket(self, s: str, pos: int, brackets: list, delims: list, chain: Chain, word) -> int:
        if not brackets:
            word("]")
            return pos + 1
        node, start, image, active, below = brackets.pop()
        if not active:
            word("]")
            return pos + 1
        target = self.target(s, pos + 1, s[start:pos])
        if target is None:
            word("]")
            return pos + 1
        url, title, end = target
        made = Md("image" if image else "link", url=url, title=title)
        self.emphasis(delims, below)
        inner = Md("head")
        if node.next is not None:
            inner.next, node.next.prev = node.next, inner
        made.children = self.collect(inner)
        before = node.prev
        before.next, made.prev, made.next = made, before, None
        del delims[below:]
        if not image:
            for b in brackets:
                if not b[2]:
                    b[3] = False
        chain.tail = made
        return end

    def target(self, s: str, pos: int, label: str) -> tuple[str, str, int] | None:
        """URL, title and end of what follows a closing bracket."""
        if s[pos : pos + 1] == "(" and (got := self.inline_target(s, pos + 1)) is not None:
            return got
        if s[pos : pos + 1] == "[" and (m := re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S).match(s, pos)):
            ref = self.refs.get(_label(m[1] or label))
            return (*ref, m.end()) if ref else None
        ref = self.refs.get(_label(label)) if self.refs and len(label) < 1000 else None
        return (*ref, pos) if ref else None

    def inline_target(self, s: str, i: int) -> tuple[str, str, int] | None:
        space = re.compile(r"[ \t]*\n?[ \t]*")
        i = space.match(s, i).end()
        if s[i : i + 1] == "<":
            m = re.compile(r"<((?:[^<>\n\\]|\\.)*)>").match(s, i)
            if not m:
                return None
            url, i = m[1], m.end()
        else:
            depth, j = 0, i
            while j < len(s) and not (s[j].isspace() or ord(s[j]) < 32):
                if s[j] == "\\" and j + 1 < len(s):
                    j += 1
                elif s[j] == "(":
                    depth += 1
                    if depth > 32:
                        return None
                elif s[j] == ")":
                    if not depth:
                        break
                    depth -= 1
                j += 1
            if depth:
                return None
            url, i = s[i:j], j
        j = space.match(s, i).end()
        title = ""
        if j > i and (m := re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)", re.S).match(s, j)):
            title, j = next(g for g in m.groups() if g is not None), space.match(s, m.end()).end()
        return (unescape(url), unescape(title), j + 1) if s[j : j + 1] == ")" else None

    def emphasis(self, delims: list, below: int) -> None:
        """Match closers with the nearest openers above ``below``."""
        floor: dict[tuple, int] = {}
        k = below
        while k < len(delims):
            closer = delims[k]
            if not closer[4] or not closer[2]:
                k += 1
                continue
            sign = closer[1]
            kind = (sign, closer[3], closer[5] % 3)
            j = k - 1
            bottom = max(below, floor.get(kind, below))
            while j >= bottom:
                o = delims[j]
                if o[1] == sign and o[3] and o[2] and not (sign != "~" and (o[4] or closer[3]) and (o[5] + closer[5]) % 3 == 0 and (o[5] % 3 or closer[5] % 3)) and not (sign == "~" and o[2] != closer[2]):
                    break
                j -= 1
            if j < bottom:
                floor[kind] = k
                k += 1
                continue
            o = delims[j]
            use = o[2] if sign == "~" else 2 if o[2] >= 2 and closer[2] >= 2 else 1
            made = Md("strike" if sign == "~" else "strong" if use == 2 else "emph")
            inner = Md("head")
            if o[0].next is not closer[0]:
                first, last = o[0].next, closer[0].prev
                inner.next, first.prev, last.next = first, inner, None
            made.children = self.collect(inner)
            o[0].next, made.prev, made.next, closer[0].prev = made, o[0], closer[0], made
            for d in (o, closer):
                d[2] -= use
                d[0].text = d[1] * d[2]
            for d in delims[j + 1 : k]:
                d[2] = 0
            if not closer[2]:
                k += 1
        for d in delims[below:]:
            d[3] = d[4] = False

    def linked(self, nodes: list[Md]) -> list[Md]:
        """Bare URLs, www. hosts and mail addresses of text nodes as links."""
        if not self.autolink:
            return nodes
        out: list[Md] = []
        for n in nodes:
            if n.kind != "text":
                if n.kind not in ("link", "image", "code", "html"):
                    n.children = self.linked(n.children)
                out.append(n)
                continue
            at = 0
            if "://" not in n.text and "www." not in n.text.lower() and "@" not in n.text:
                out.append(n)
                continue
            for m in _BARE_URL.finditer(n.text):
                url = self.trim_url(m[0])
                if "@" in url and not re.match(r"(?:https?|ftp)://|www\.", url, re.I):
                    if url[-1] in "-_" or "_" in url.rsplit("@", 1)[1].rsplit(".", 2)[-1]:
                        continue
                    href = "mailto:" + url
                else:
                    host = re.sub(r"^(?:[a-z]+://)", "", url, flags=re.I)
                    if not re.match(r"[\w\[]", host):
                        continue
                    href = "http://" + url if url[:4].lower() == "www." else url
                if m.start() > at:
                    out.append(Md("text", n.text[at : m.start()]))
                link = Md("link", url=href)
                link.children = [Md("text", url)]
                out.append(link)
                at = m.start() + len(url)
            if at < len(n.text):
                out.append(Md("text", n.text[at:]))
        return out

    @staticmethod
    def trim_url(url: str) -> str:
        """Without closing punctuation, unmatched parentheses and references at the end."""
        opened, closed = url.count("("), url.count(")")
        while url:
            if url[-1] in "?!.,:*_~'\"":
                url = url[:-1]
            elif url[-1] == ")" and closed > opened:
                url, closed = url[:-1], closed - 1
            elif url[-1] == ";" and (m := re.search(r"&[A-Za-z0-9]+;\Z", url[-40:])):
                url = url[: -len(m[0])]
            else:
                break
        return url


def parse(text: str, tables: bool = True, strikethrough: bool = True, autolink: bool = True) -> Md:
    return Parser(tables, strikethrough, autolink).parse(text)
