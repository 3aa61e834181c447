"""URLs of Markdown: links and images of the tree, then bare domains with a registrable ICANN suffix."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.url_rules import is_safe_image, is_safe_link
from papyrine.operators.markdown import Md, parse

#: The public suffix list of the system: a parameter, read on the driver and sent along, so all workers use one list.
SUFFIX_FILE = "/usr/share/publicsuffix/public_suffix_list.dat"
SCHEMA = "struct<link_urls array<string>, image_urls array<string>>"

_DOMAIN = re.compile(r"(?ai:\b([a-z0-9][a-z0-9-]*(?:\.[a-z0-9][a-z0-9-]+)+))(/\S*)?")
_SKIPPED = frozenset("code code_block html html_block link image".split())


Suffixes = tuple[frozenset[str], frozenset[str], frozenset[str]]


@lru_cache(maxsize=2)
def suffixes(path: str = SUFFIX_FILE) -> Suffixes:
    """Rules, wildcard parents and exceptions of the ICANN section of a public suffix list."""
    rules, wild, exceptions, inside = set(), set(), set(), False
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            if line.startswith("//"):
                inside = "===BEGIN ICANN" in line or inside and "===END ICANN" not in line
            elif inside and line:
                rule = line.split()[0].lower()
                (exceptions if rule[0] == "!" else wild if rule[:2] == "*." else rules).add(rule.lstrip("!").removeprefix("*."))
    return frozenset(rules), frozenset(wild), frozenset(exceptions)


def registrable(host: str, known: Suffixes) -> bool:
    """Whether the host has a label before its longest ICANN suffix."""
    if len(host) > 253:
        return False
    rules, wild, exceptions = known
    labels = host.lower().split(".")
    for k in range(len(labels)):
        tail, above = ".".join(labels[k:]), ".".join(labels[k + 1 :])
        if tail in exceptions:
            return True
        if tail in rules or above and above in wild:
            return k > 0
    return False


def bare_domains(text: str, known: Suffixes) -> list[str]:
    """Domains written without a scheme, with their path; none that follows ``@``."""
    out = []
    for m in _DOMAIN.finditer(text):
        if not (m.start() and text[m.start() - 1] == "@") and registrable(m[1], known):
            out.append(m[1] + (m[2] or "").rstrip(".,;?!:"))
    return out


def extract(text: str, known: Suffixes | None = None) -> tuple[list[str], list[str]]:
    """Distinct links in order of appearance, and all images."""
    known = known or suffixes()
    root = parse(text, tables=False, strikethrough=False)
    links, images = [], []
    for n in root.walk():
        if n.kind == "link" and n.url and is_safe_link(n.url):
            links.append(n.url)
        elif n.kind == "image" and n.url and is_safe_image(n.url):
            images.append(n.url)
    stack: list[Md] = [root]
    while stack:
        n = stack.pop()
        if n.kind == "text":
            links += bare_domains(n.text, known)
        elif n.kind not in _SKIPPED:
            stack.extend(reversed(n.children))
    return list(dict.fromkeys(links)), images


def extract_markdown_urls(text: Column, suffix_file: str = SUFFIX_FILE) -> Column:
    """``struct<link_urls, image_urls>``; null stays null. Without the suffix file on the driver it fails."""
    known = suffixes(suffix_file)

    @F.arrow_udf(SCHEMA)
    def run(v: pa.Array) -> pa.Array:
        out = [None if x is None else dict(zip(("link_urls", "image_urls"), extract(x, known))) for x in v.to_pylist()]
        return pa.array(out, pa.struct([("link_urls", pa.list_(pa.string())), ("image_urls", pa.list_(pa.string()))]))

    return run(text)
