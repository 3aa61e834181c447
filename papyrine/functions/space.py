"""White space as Unicode defines it: the information separators U+001C to U+001F, which Python strips, are none."""

from __future__ import annotations

import re

#: The characters with the property White_Space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{WHITE}]+")


def trim(text: str) -> str:
    return text.strip(WHITE)


def collapse(text: str) -> str:
    """Runs of white space as one space, none at the ends."""
    return _RUN.sub(" ", text).strip(" ")
