"""Matching of column names against keyword patterns.

Column names are split into lower-case tokens (``_``, ``-``, blanks, dots and
camelCase). A keyword matches when its own tokens occur consecutively. The
``substring`` mode looks for the plain substring instead, which also hits
``age`` inside ``percentage``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

MODES = ("token", "substring")
# Forms of a keyword, besides a final s, that count as the keyword.
INFLECTIONS = {
    "employ": ("employed", "employer", "employee", "employees", "employment"), "salary": ("salaries",), "birth": ("birthday", "birthdate", "birthyear"), "retired": ("retiree", "retirees"),
    "education": ("educational",), "score": ("scored", "scoring"), "gender": ("gendered",), "percent": ("pct",), "email": ("emailaddress",), "phone": ("phonenumber",), "postal": ("postalcode",),
}


def tokens(name: str) -> list[str]:
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return [t for t in re.split(r"[^a-z0-9]+", spaced.lower()) if t]


def _same(token: str, keyword: str) -> bool:
    return token in (keyword, keyword + "s", *INFLECTIONS.get(keyword, ()))


def matches(name: str, keywords: str | Iterable[str], mode: str = "token") -> bool:
    """True when any keyword occurs in the column name."""
    if mode not in MODES:
        raise ValueError(f"unknown match mode: {mode}")
    words = [keywords] if isinstance(keywords, str) else list(keywords)
    if mode == "substring":
        return any(w in name.lower() for w in words)
    have = tokens(name)
    for word in words:
        want = tokens(word)
        for start in range(len(have) - len(want) + 1):
            if all(_same(have[start + i], want[i]) for i in range(len(want))):
                return True
    return False
