"""Decoding character references to a fix-point under a budget of work."""

from __future__ import annotations

import re
from functools import lru_cache
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.url_rules import scalar

#: Bytes of work allowed for a text.
WORK_FACTOR = 64
LEAST_WORK = 1024
MOST_NESTED_WORK = 1_000_000
FULL_PASSES = 2

#: Names read in any case, with what they stand for.
ANY_CASE = {
    "amp;": "&",
    "amp": "&",
    "lt;": "<",
    "lt": "<",
    "gt;": ">",
    "gt": ">",
    "quot;": '"',
    "quot": '"',
    "apos;": "'",
    "nbsp;": " ",
    "nbsp": " ",
    "colon;": ":",
    "lsqb;": "[",
    "rsqb;": "]",
    "lbrack;": "[",
    "rbrack;": "]",
    "vert;": "|",
    "verbar;": "|",
    "sol;": "/",
}


#: What can follow ``&``: a name or number that ends, or letters and digits that do not.
_BODY = re.compile(r"([A-Za-z][0-9A-Za-z]*+;)|#(?:([0-9]++)|[xX]([0-9A-Fa-f]++));|([0-9A-Za-z]++)(?!;)")


class _Names(dict):
    """Meanings of names as they are spelled; others are looked up once and kept."""

    def __init__(self) -> None:
        super().__init__(html5)
        spelled: dict[str, set[str]] = {}
        for name, meaning in html5.items():
            spelled.setdefault(name.lower(), set()).add(meaning)
        self.any_case = {name: next(iter(meanings)) for name, meanings in spelled.items() if len(meanings) == 1} | ANY_CASE
        self.endless = {name.lower() for name in html5 if not name.endswith(";")}

    def __missing__(self, name: str) -> str | None:
        return self.any_case.get(name.lower())


@lru_cache(maxsize=1)
def _names() -> _Names:
    return _Names()


def _one_pass(text: str, blank: bool = False) -> str:
    """Each reference replaced by what it stands for, or by a space; unknown ones stay unless blanked.

    What stands between two ampersands is read from its start. A name without end
    takes the sign after it along: if that is an ampersand, it starts nothing in this pass.
    """
    names = _names()
    first, *pieces = text.split("&")
    out, taken = [first], False
    for k, piece in enumerate(pieces):
        m = None if taken else _BODY.match(piece)
        taken = False
        if m is None or m[4] and m[4].lower() not in names.endless:
            out.append("&" + piece)
            continue
        if blank:
            meaning = " "
        elif m[2] or m[3]:
            meaning = scalar(m[2], 10) if m[2] else scalar(m[3], 16)
        else:
            meaning = names[m[1] or m[4]]
        out.append(("&" + m[0] if meaning is None else meaning) + piece[m.end() :])
        taken = m[4] is not None and m.end() == len(piece) and k + 1 < len(pieces)
    return "".join(out)


def _size(text: str) -> int:
    return max(1, len(text.encode("utf-8", "surrogatepass")))


def decode(text: str) -> str:
    """All references decoded, also those that decoding makes, until none is left or the work is used up.

    What is left then becomes a space. The first pass always runs.
    """
    size = len(text.encode("utf-8", "surrogatepass"))
    left = max(FULL_PASSES * size, min(MOST_NESTED_WORK, max(LEAST_WORK, WORK_FACTOR * size)))
    while (after := _one_pass(text)) != text:
        left -= _size(text)
        if left < _size(after):
            return _one_pass(after, blank=True)
        text = after
    return text


def decode_entities(c: Column) -> Column:
    """``decode`` for a Column: rows without ``&`` send a null payload and return at once."""

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decode(x) for x in v.to_pylist()], pa.string())

    return F.coalesce(run(F.when(c.contains("&"), c)), c)
