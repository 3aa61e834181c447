"""Stripping prompt-injection patterns from untrusted text.

A chain of native regex replacements; only reference decoding of rows that hold an
``&`` runs in Python. Every group loop is possessive: a plain one overflows the
stack of the task on a tag of a few thousand characters.

Two signs of private use mark where markup was: B where any, R where a structural
tag. They count as white space inside injection phrases, and a role label right
after R is at the start of a line. Results: null stays null, '' stays ''.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.operators.entities import decode_entities

B, R = "\ue000", "\ue001"

#: Tags after which a role label starts a line.
STRUCTURAL_TAGS = (
    "h1 h2 h3 h4 h5 h6 header head "
    "caption col colgroup table tbody td tfoot th thead tr "
    "dd dl dt li ol ul menu "
    "body html main script style title template noscript "
    "address article aside blockquote br details dialog div fieldset figcaption figure footer form hr legend nav p pre section summary"
).split()

_SEP = r"[\s\x{E000}\x{E001}]++"
_REST = r"""(?:"[^"]*+"|'[^']*+'|[^>"']++)*+"""


def _word(*choices: str) -> str:
    """One of the words with the space after it."""
    return f"(?:{'|'.join(choices)}){_SEP}"


#: Words that say whose instructions, and what is to be dropped.
_WHOSE = _word("the", "your", "my", "our")
_WHAT = "(?:instruction|prompt)s?"
#: Phrases: a verb, how much of it, whose, and what.
_EARLIER = f"(?:{_word('all')})?(?:{_WHOSE})?{_word('previous')}"
_EVERY = f"{_word('all')}(?:{_WHOSE})?"
_ANY = f"(?:{_WHOSE})*+(?:{_word('all', 'previous')})++(?:{_WHOSE})?"
PHRASES = (
    f"{_word('ignore', 'disregard')}(?:{_EARLIER}|{_EVERY}){_WHAT}",
    f"{_word('forget')}(?:{_ANY}(?:{_WHAT}|above)|{_word('everything')}above)",
)
#: Control tokens of chat formats.
TOKENS = ("im_start", "im_end", "begin_of_text", "start_header_id", "end_header_id", "eot_id")
#: The look-ahead lets the engine pass over most characters before it tries word boundaries.
INJECTION = rf"(?iU)(?=[ifd<\[])(?:\b(?:{'|'.join(PHRASES)})|<(?:\|(?:{'|'.join(TOKENS)})\|>|/?system\b{_REST}>)|\[/?INST\])"
FORMAT_SIGNS = r"[\p{Cf}\x{E000}\x{E001}]"
COMMENT = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"
TAG = rf"<(?=/?([A-Za-z][^\t\n\f\r >/]*+))/?[A-Za-z]{_REST}>"
#: A run of spaces is tried from its start alone, or from where the last match ended.
ROLE = r"(?imdU)(^[^\S\n]*+(?:\x{E000}[^\S\n]*+)*+|(?:\G|(?<![^\S\n]))[^\S\n]*+\x{E001}(?:[^\S\n]*+\x{E000})*+[^\S\n]*+)(?:system|assistant):[^\S\n]*+"
LABEL = r"(?iU)(?:system|assistant):"
HORIZONTAL = r"(?U)[^\S\n]++"
SPACE = r"(?U)\s++"
BLANK_LINES = r"\n{3,}"
#: Comments and tags become signs between spaces, in these steps; what is no tag stays.
MARKUP_STEPS = (
    (COMMENT, f" {B} "),
    (TAG, f"{B}{R}$1{R}{B}"),
    (rf"(?i){B}{R}(?:{'|'.join(STRUCTURAL_TAGS)}){R}{B}", f" {R} "),
    (f"{B}{R}[^{B}{R}]*+{R}{B}", f" {B} "),
)


def strip_phrases(c: Column) -> Column:
    return F.regexp_replace(c, INJECTION, " ")


def strip_markup(c: Column) -> Column:
    for pattern, to in MARKUP_STEPS:
        c = F.regexp_replace(c, pattern, to)
    return c


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value of ``c``, which is computed once however often ``body`` names it: conditions do not share it otherwise."""
    return F.element_at(F.transform(F.array(c), body), 1)


def strip_roles(c: Column) -> Column:
    """Role labels at line starts and after structural tags; the signs of markup become spaces."""
    return F.translate(let(c, lambda x: F.when(x.rlike(LABEL), F.regexp_replace(x, ROLE, "$1")).otherwise(x)), B + R, "  ")


def collapse(c: Column, title: bool) -> Column:
    """White space collapsed; what is left of it at the ends is spaces and line feeds."""
    if title:
        return F.btrim(F.regexp_replace(c, SPACE, " "))
    return F.btrim(F.regexp_replace(F.regexp_replace(c, HORIZONTAL, " "), BLANK_LINES, "\n\n"), F.lit(" \n"))


def sanitize_decoded(c: Column, title: bool = False) -> Column:
    """The chain after reference decoding. A text without phrases and ``<`` needs no second pass."""
    c = F.regexp_replace(c, FORMAT_SIGNS, " ")
    both = F.struct(c.alias("before"), strip_phrases(c).alias("after"))
    same = lambda x: (x["before"] == x["after"]) & ~x["after"].contains("<")
    c = let(both, lambda x: F.when(same(x), x["after"]).otherwise(strip_phrases(strip_markup(x["after"]))))
    return collapse(strip_roles(c), title)


def sanitize_prompt_injection(c: Column, title: bool = False) -> Column:
    """Text without injection phrases, markup and role labels."""
    return sanitize_decoded(decode_entities(c), title)
