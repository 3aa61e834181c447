"""Clean text from HTML, Markdown, wiki and LaTeX residue, with its structure kept.

The text is read as nested constructs, outermost first: fenced code; comments and
formulas; inline code; wiki tables and templates; environments and commands; links;
emphasis; headings, items, quotes and table rows at line starts; tags and character
references. Each construct read leaves its content in one plain convention and names
its kind:

* headings stand alone between empty lines, list items begin with ``• ``,
* code blocks are indented by four spaces, table cells are parted by a tab,
* formulas keep their source without their delimiters; images keep their caption.

Code and formulas are put aside before anything else is read, so signs inside them
are never markup. Constructs that may hold others are read with a stack, those that run
to a distant end by one search for each kind of end, so a text costs time in proportion
to its length, whatever is left open in it. Bare URLs, sums of money, comparisons, file paths, ``#12`` and
``[sic]`` match no construct.

Results: null stays null with no kinds, '' stays ''; unclosed constructs are text,
except tags, which are dropped, and fences, which hold to the end.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.splitting import fenced

KINDS = ("html", "markdown", "wiki", "latex")

#: Signs of private use, deleted from texts first: around the number of what is put aside, and for a table's rule.
OPEN, CLOSE, ROWS = "\ue000", "\ue001", "\ue002"
_OWN = dict.fromkeys(map(ord, (OPEN, CLOSE, ROWS)))
_ASIDE = re.compile(f"{OPEN}(\\d+){CLOSE}")

_COMMENT = re.compile(r"<!--|<!\[CDATA\[|<!DOCTYPE\b|<(script|style)\b", re.I)
_SCRIPT_END, _STYLE_END = re.compile(r"</script\s*>", re.I), re.compile(r"</style\s*>", re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[A-Za-z_:@][\w:.\-]*(?:\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'|[^\s\"'<>=`]+))?)*)\s*/?>")
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_MATH = re.compile(r"\$\$|\\\[|\\\(|\\begin\{((?:equation|align|gather|multline|displaymath|math|eqnarray)\*?)\}")
_INLINE_MATH = re.compile(r"(?<![\\$\w])\$(?!\$)((?:[^$\n\\]|\\.)++)\$(?![\d$])")
_FORMULA = re.compile(r"\\[A-Za-z]|[\^_]\{|[\^_=]|[A-Za-z]\(|\A[A-Za-z]\Z")
_CODE = re.compile(r"(?<!`)(`+)(?!`)([^\n]+?)(?<!`)\1(?!`)")
_WIKI_TABLE = re.compile(r"^[ \t]*+\{\|", re.M)
_WIKI_TABLE_END = re.compile(r"^[ \t]*+\|\}[ \t]*+$", re.M)
_BRACES = re.compile(r"\{+|\}+")
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n|]+)((?:\|[^\[\]\n|]*)*)\]\]")
_WIKI_URL = re.compile(r"\[(?:https?|ftp|mailto):[^\s\[\]]++(?: ++([^\[\]\n]*+))?\](?!\()")
_WIKI_BOLD = re.compile(r"(?<!')('{2,5})(?!')([^\n]+?)(?<!')\1(?!')")
_WIKI_HEADING = re.compile(r"^[ \t]*+(={2,6})(?!=)[ \t]*+([^=\n][^\n]*)$", re.M)
_WIKI_WORD = re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__")
_LATEX_HEADING = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?(?:\[[^\[\]\n]*\])?\{([^{}\n]*)\}")
_LATEX_DROP = re.compile(r"~?\\(?:ref|eqref|pageref|cite[a-z]*|label|bibliography|bibliographystyle|usepackage|documentclass|includegraphics|input|include|vspace|hspace)\*?(?:\[[^\[\]\n]*\])*+\{[^{}\n]*\}")
_LATEX_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})?")
_LATEX_ITEM = re.compile(r"^[ \t]*\\item\b[ \t]*(?:\[([^\[\]\n]*)\])?[ \t]*", re.M)
_LATEX_COMMAND = re.compile(r"(\\[A-Za-z]++\*?(?:\[[^\[\]\n]*\])?\{)|[{}\n]")
_LATEX_SIGN = re.compile(r"(?<![\\\w])\\([%&_#$])(?![A-Za-z])|(?<!\w:)(?<!\\)\\(?:newline|noindent|LaTeX|TeX|ldots|dots|textbackslash|maketitle|tableofcontents|centering|hline|par|clearpage|newpage|medskip|bigskip|smallskip)\b")
_IMAGE = re.compile(r"!\[([^\[\]\n]*)\](?:\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)|\[[^\[\]\n]*\])")
_LINK = re.compile(r"(?<!\\)\[([^\[\]\n]+)\](?:\(<?[^()\s]*(?:\([^()\s]*\)[^()\s]*)*>?(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)|\[[^\[\]\n]*\])")
_LINK_TARGET = re.compile(r"^ {0,3}\[[^\[\]\n]+\]:[ \t]+\S+.*$\n?", re.M)
_EMPHASIS = (
    re.compile(r"(?<![\\*])(\*{1,3})(?![\s*])([^*\n]*[^\s*\\])\1(?!\*)"),
    re.compile(r"(?<![\\~])(~~)(?![\s~])([^~\n]*[^\s~])\1(?!~)"),
)
_UNDERLINES = re.compile(r"_+|\n")
_HEADING = re.compile(r"^[\u200b\u2060\ufeff]* {0,3}#{1,6}[^\S\n]++(\S[^\n]*)$", re.M)
_UNDERLINED = re.compile(r"^(?=[^\n]*\w)([^\n|]+)\n {0,3}(?:={3,}|-{3,})[ \t]*$", re.M)
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$\n?", re.M)
_TABLE_RULE = re.compile(r"^[ \t]*+\|?[ \t]*+:?-{2,}:?[ \t]*+(?:\|[ \t]*+:?-{2,}:?[ \t]*+)+\|?[ \t]*+$|^[ \t]*+\|[ \t]*+:?-{2,}:?[ \t]*+\|[ \t]*+$", re.M)
_ITEM = re.compile(r"^([^\S\n]*)[\u200b\u2060\ufeff]*(?:[-*+]|\d{1,9}[.)])[^\S\n]+(?=\S)", re.M)
_QUOTE = re.compile(r"^[ \t]{0,3}(?:>[ \t]?)+(?=[ \t]*\S)", re.M)
_BLANKS = re.compile(r"\n[ \t]*\n(?:[ \t]*\n)+")

_BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hr html main nav p pre section summary table tbody tfoot thead tr ul ol".split())


class _Reading:
    """One text being read: constructs put aside, kinds seen."""

    def __init__(self) -> None:
        self.kinds: set[str] = set()
        self.aside: list[str] = []

    def put(self, kind: str, text: str) -> str:
        self.kinds.add(kind)
        self.aside.append(text)
        return f"{OPEN}{len(self.aside) - 1}{CLOSE}"

    def seen(self, kind: str, text: str) -> str:
        self.kinds.add(kind)
        return text

    def restore(self, text: str) -> str:
        for _ in range(3):
            if OPEN not in text:
                break
            text = _ASIDE.sub(lambda m: self.aside[int(m[1])], text)
        return text

    def sub(self, pattern: re.Pattern, kind: str, text: str, to) -> str:
        return pattern.sub(lambda m: self.seen(kind, to(m)), text)

    def enclosed(self, t: str, start: re.Pattern, end_of, to) -> str:
        """Constructs from a start to their next end: ``end_of`` names the end of a start, ``to`` makes its text of start and content."""
        out, at, ends = [], 0, {}
        m = start.search(t)
        while m:
            wanted: str | re.Pattern = end_of(m)
            a, b = ends.get(wanted, (0, 0))
            if a < m.end() + 1:  # searched once up to each end; none left means none further on
                found = wanted.search(t, m.end() + 1) if isinstance(wanted, re.Pattern) else None
                a = t.find(wanted, m.end() + 1) if isinstance(wanted, str) else found.start() if found else -1
                b = a + len(wanted) if isinstance(wanted, str) else found.end() if found else -1
                a, b = ends[wanted] = (a, b) if a >= 0 else (len(t) + 1, -1)
            if b < 0:
                m = start.search(t, m.end())
                continue
            out += [t[at : m.start()], to(m, t[m.end() : a])]
            at = b
            m = start.search(t, at)
        return "".join([*out, t[at:]]) if out else t

    def comment(self, m: re.Match, content: str) -> str:
        return self.seen("html", "")

    def formula(self, m: re.Match, content: str) -> str:
        put = self.put("latex", content.strip())
        return put if m[0] == "\\(" else f"\n{put}\n"

    def inline_math(self, t: str) -> str:
        out, at, start = [], 0, 0
        while m := _INLINE_MATH.search(t, start):
            if _FORMULA.search(m[1]):
                out += [t[at : m.start()], self.put("latex", m[1].strip())]
                at = start = m.end()
            else:
                start = m.end() - 1
        return "".join([*out, t[at:]]) if out else t

    def templates(self, t: str) -> str:
        """Without templates, innermost first; a single brace inside makes a template text."""
        out: list[str] = []
        open_: list[int] = []
        at = 0
        for m in _BRACES.finditer(t):
            out.append(t[at : m.start()])
            at = m.end()
            pairs, odd = divmod(len(m[0]), 2)
            for k in range(pairs + odd):
                if odd and k == (0 if m[0][0] == "{" else pairs):  # the odd brace is the outer one
                    open_.clear()
                    out.append(m[0][0])
                elif m[0][0] == "{":
                    open_.append(len(out))
                    out.append("{{")
                elif open_ and any(out[open_[-1] + 1 :]):
                    del out[open_.pop() :]
                    self.kinds.add("wiki")
                else:
                    open_.clear()
                    out.append("}}")
        return "".join([*out, t[at:]])

    def commands(self, t: str) -> str:
        """Commands replaced by what their braces hold; a brace of no command or a line end inside makes a command text."""
        out: list[str] = []
        open_: list[int] = []
        at = 0
        for m in _LATEX_COMMAND.finditer(t):
            out.append(t[at : m.start()])
            at = m.end()
            if m[1]:
                open_.append(len(out))
                out.append(m[0])
            elif m[0] == "}" and open_:
                out[open_.pop()] = ""
                self.kinds.add("latex")
            else:
                open_.clear()
                out.append(m[0])
        return "".join([*out, t[at:]])

    def underlines(self, t: str) -> str:
        """Emphasis by one to three underlines: a run that opens and the next run of its length on the line that closes."""
        runs, line = [], 0
        for m in _UNDERLINES.finditer(t):
            if m[0] == "\n":
                line += 1
                continue
            a, b = m.span()
            before, after = t[a - 1 : a] or "\n", t[b : b + 1] or "\n"
            word = lambda c: c.isalnum() or c == "_"
            opens = b - a <= 3 and not (word(before) or before == "\\") and not after.isspace()
            closes = b - a <= 3 and not (before.isspace() or before == "\\") and not word(after)
            runs.append((a, b, line, opens, closes))
        later: list[int] = [0] * len(runs)
        last: dict[int, int] = {}
        for k in range(len(runs) - 1, -1, -1):
            a, b, line, _, closes = runs[k]
            later[k] = last.get(b - a, -1)
            if closes:
                last[b - a] = k
        out, at, k = [], 0, 0
        while k < len(runs):
            a, b, line, opens, _ = runs[k]
            z = later[k]
            if opens and z > k and runs[z][2] == line:
                out += [t[at:a], self.seen("markdown", t[b : runs[z][0]])]
                at = runs[z][1]
                k = z
            k += 1
        return "".join([*out, t[at:]]) if out else t

    def heading(self, m: re.Match) -> str:
        bare = m[1].rstrip(" \t").rstrip("#").rstrip(" \t") or m[1][0]
        return self.seen("markdown", f"\n{bare}\n")

    def wiki_heading(self, m: re.Match) -> str:
        body = m[2].rstrip(" \t")
        bare = body[: -len(m[1])]
        return self.seen("wiki", f"\n{bare.rstrip(' \t')}\n") if body.endswith(m[1]) and bare.strip(" \t") and bare[-1] != "=" else m[0]

    def prose(self, t: str) -> str:
        if "<" in t:
            ends = {"<!--": "-->", "<![cdata[": "]]>", "<!doctype": ">", "<script": _SCRIPT_END, "<style": _STYLE_END}
            t = self.enclosed(t, _COMMENT, lambda m: ends[m[0].lower()], self.comment)
        if "\\" in t or "$" in t:
            ends = {"$$": "$$", "\\[": "\\]", "\\(": "\\)"}
            t = self.enclosed(t, _MATH, lambda m: ends.get(m[0]) or f"\\end{{{m[1]}}}", self.formula)
            if "$" in t:
                t = self.inline_math(t)
        if "`" in t:
            t = _CODE.sub(lambda m: self.put("markdown", m[2].strip()), t)
        if "{" in t:
            if "{|" in t:
                t = self.enclosed(t, _WIKI_TABLE, lambda m: _WIKI_TABLE_END, lambda m, x: self.wiki_table(m[0] + x + "|}"))
            if "{{" in t:
                t = self.templates(t)
        if "\\" in t:
            t = self.sub(_LATEX_HEADING, "latex", t, lambda m: f"\n\n{m[1]}\n\n")
            t = self.sub(_LATEX_DROP, "latex", t, lambda m: "")
            t = self.sub(_LATEX_ENV, "latex", t, lambda m: "")
            t = self.sub(_LATEX_ITEM, "latex", t, lambda m: "• " + (m[1] + " " if m[1] else ""))
            t = self.commands(t)
            t = self.sub(_LATEX_SIGN, "latex", t, lambda m: m[1] or "")
        if "[" in t:
            t = self.sub(_WIKI_LINK, "wiki", t, lambda m: (m[2].rsplit("|", 1)[1] if m[2] else m[1]).strip())
            t = self.sub(_IMAGE, "markdown", t, lambda m: m[1])
            t = self.sub(_LINK, "markdown", t, lambda m: m[1])
            t = self.sub(_WIKI_URL, "wiki", t, lambda m: m[1] or "")
            t = self.sub(_LINK_TARGET, "markdown", t, lambda m: "")
        if "''" in t:
            t = self.sub(_WIKI_BOLD, "wiki", t, lambda m: m[2])
        if "__" in t:
            t = self.sub(_WIKI_WORD, "wiki", t, lambda m: "")
        if "==" in t:
            t = _WIKI_HEADING.sub(self.wiki_heading, t)
        if "<" in t:
            t = self.sub(_TAG, "html", t, self.tag)
        if "&" in t:
            t = _REFERENCE.sub(self.reference, t)
        if "#" in t:
            t = _HEADING.sub(self.heading, t)
        if "--" in t or "===" in t:
            t = self.sub(_TABLE_RULE, "markdown", t, lambda m: ROWS)
            t = self.sub(_UNDERLINED, "markdown", t, lambda m: f"\n{m[1]}\n")
        if ROWS in t:
            t = "\n".join(self.row(x) for x in t.split("\n") if x != ROWS)
        if ">" in t:
            t = self.sub(_QUOTE, "markdown", t, lambda m: "")
        t = self.sub(_RULE, "markdown", t, lambda m: "") if "***" in t or "---" in t or "___" in t or "* *" in t else t
        t = self.sub(_ITEM, "markdown", t, lambda m: m[1] + "• ")
        for _ in range(2):
            if "*" in t:
                t = self.sub(_EMPHASIS[0], "markdown", t, lambda m: m[2])
        for _ in range(2):
            if "_" in t:
                t = self.underlines(t)
        for _ in range(2):
            if "~" in t:
                t = self.sub(_EMPHASIS[1], "markdown", t, lambda m: m[2])
        return t

    def row(self, line: str) -> str:
        bare = line.strip()
        return "\t".join(x.strip() for x in bare[1:].removesuffix("|").split("|")) if bare.startswith("|") and bare.count("|") > 1 else line

    def wiki_table(self, text: str) -> str:
        rows, cells = [], []
        for line in text.strip().split("\n")[1:]:
            line = line.strip()
            if line.startswith(("|-", "|}")):
                rows.append(cells)
                cells = []
            elif line.startswith("|+"):
                rows += [[line[2:].strip()]]
            elif line[:1] in "|!":
                cells += [x.rsplit("|", 1)[-1].strip() for x in re.split(r"\|\||!!", line[1:])]
            elif cells:
                cells[-1] += " " + line
        return self.put("wiki", "\n" + "\n".join("\t".join(r) for r in [*rows, cells] if r) + "\n")

    def tag(self, m: re.Match) -> str:
        name = m[2].lower()
        if re.fullmatch("h[1-6]", name):
            return "\n\n"
        if name == "li":
            return "" if m[1] else "\n• "
        if name in ("td", "th"):
            return "\t" if m[1] else ""
        return "\n" if name == "br" or name in _BLOCK_TAGS else ""

    def reference(self, m: re.Match) -> str:
        plain = html.unescape(m[0])
        return m[0] if plain == m[0] else self.seen("html", plain)


def clean(text: str) -> tuple[str, list[str]]:
    """The clean text and the kinds of markup read."""
    reading = _Reading()
    text = text.replace("\r\n", "\n").replace("\r", "\n").translate(_OWN)
    parts, at = [], 0
    for a, b in fenced(text) if "```" in text or "~~~" in text else []:
        parts.append(reading.prose(text[at:a]))
        lines = text[a:b].rstrip("\n").split("\n")
        closed = len(lines) > 1 and not lines[-1].strip().strip("`~")
        reading.kinds.add("markdown")
        parts.append("\n\n" + reading.put("markdown", "\n".join("    " + x for x in lines[1 : len(lines) - closed])) + "\n\n")
        at = b
    parts.append(reading.prose(text[at:]))
    out = reading.restore(_BLANKS.sub("\n\n", "".join(parts))).strip("\n") if reading.kinds else text
    return out, [k for k in KINDS if k in reading.kinds]


def cleaned(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``*keys, text, kinds`` of each row: a narrow map that reads only these columns."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", text string, kinds array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [(None, []) if x is None else clean(x) for x in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))], names=[*keys, "text", "kinds"])

    return df.select(*keys, F.col(text)).mapInArrow(run, schema)
