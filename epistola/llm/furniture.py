"""Page furniture in text from scanned pages: page numbers, page stamps and running headers."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from difflib import SequenceMatcher

_PAGE = re.compile(r"^\W{0,3}(?:p(?:age|g|p)?[.,]?\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|\d{1,3}\s*(?:of|/)\s*\d{1,3})\W{0,3}$|^[\[(-]\s*\d{1,4}\s*[\])-]$", re.I)
_STAMP = re.compile(r"^(?:[A-Z][A-Z0-9]{1,5}[- ]?)(?:[\dlIOoSB]{4}-)?(?=\S*\d{2})[\dlIOoSB]{4,9}$")
_NUMBER = re.compile(r"^\d{1,3}$|^[ivxl]{1,4}$")
_PART = re.compile(r"\s{2,}")
_END = re.compile(r"[.!?:;,][\"'”’)\]]*$")


def _NO_STAMP(s: str) -> bool:
    return not any(c in "0123456789lIO" for c in s)


_NOT_LETTERS = re.compile(r"[^a-z]")


@lru_cache(8192)
def shape(line: str) -> str:
    """A line reduced so that misread copies of one running header look alike: letters folded, figures and blanks dropped."""
    s = line.lower()
    for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ri", "n"), ("1", "l"), ("i", "l"), ("0", "o"), ("5", "s"), ("6", "b")):
        s = s.replace(a, b)
    return _NOT_LETTERS.sub("", s)


@lru_cache(8192)
def is_stamp(line: str) -> bool:
    """Whether a line consists of page numbers and stamps only."""
    s = line.strip()
    return bool(s) and len(s) < 60 and not _NO_STAMP(s) and bool(_PAGE.match(s) or _STAMP.match(s) or all(_PAGE.match(x) or _STAMP.match(x) for x in _PART.split(s)))


def _alike(a: str, b: str) -> bool:
    """Whether two shapes differ by damage only."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85


@lru_cache(8192)
def title_like(line: str) -> bool:
    """Whether a line could be a running header: a few words, all capitalised but for particles, and no punctuation at the end."""
    s = _bare(line.strip())
    if not s or len(s) > 60 or s[0].islower():
        return False
    words = _LETTERS.findall(s)
    if not words or len(words) > 9 or _END.search(s) or "@" in s or "|" in s:
        return False
    return max(map(len, words)) >= 3 and all(w[0].isupper() or w in _PARTICLES for w in words)


_PARTICLES = frozenset("of for the and no in on to".split())


_LOW = re.compile(r"(?<![^\W_])[a-zß-öø-ÿ]{2,}(?![\w@.])")
_FULL = re.compile(r"[.!?][\"'”’]*\s*$")
_LETTERS = re.compile(r"[^\W\d_]+")
_FIGURES = re.compile(r"^\d{2,6}$")


@lru_cache(8192)
def running(line: str) -> bool:
    """Whether a line holds running text: several words in lower case, or a few and a sentence's end."""
    if "@" in line:
        return False
    n = len(_LOW.findall(line))
    return n >= 4 or n >= 2 and _FULL.search(line) is not None


def furniture_lines(lines: list[str]) -> set[int]:
    """Line indices that are page furniture by what they look like: stamps and page numbers, a bare number that interrupts running
    text or stands beside another piece of furniture, and a header: a line like a title that recurs in the text or touches one of those."""
    short = {k: s for k, x in enumerate(lines) if len(x) < 80 and 0 < len(s := x.strip()) < 60 and s[0] not in ">|"}
    out = {k for k, s in short.items() if is_stamp(s)}
    titles = {k for k, s in short.items() if k not in out and title_like(s)}
    bare = {k: _bare(short[k]) for k in titles}
    folded = {k: shape(b) for k, b in bare.items()}
    shapes = Counter(folded.values())
    again = {k for k in titles if len(folded[k]) >= 5 and shapes[folded[k]] >= 2}
    strong = {k for k in titles if _CAPTION.match(bare[k])}
    if known := {folded[k] for k in strong | again}:
        strong |= {k for k in titles - again if k > 2 and len(h := folded[k]) >= 8 and any(abs(len(h) - len(x)) <= 2 and _alike(h, x) for x in known)}
    text = lambda k: 0 <= k < len(lines) and running(lines[k])
    out |= {k for k in strong | again if k in strong or k > 2 or out}
    for k, s in short.items():
        if k not in out and _NUMBER.match(s):
            before, after = k - 1, k + 1
            if (text(before) and text(after)) or ({before, after} & out and not any(0 <= x < len(lines) and x not in out and _FIGURES.match(lines[x].strip()) for x in (before, after))):
                out.add(k)
    grown = True
    while grown:
        grown = {k for k in titles - out if k > 2 and {k - 1, k + 1} & out and (text(k - 1) or text(k + 1) or {k - 1, k + 1} <= out or not lines[k - 1].strip() or k + 1 >= len(lines))}
        out |= grown
    return out


_CAPTION = re.compile(r"^(?:[A-Z0-9][A-Z0-9 '-]+ NO\.?\s+\d+|Exhibit [A-Z0-9]{1,3}-\d{1,4}|CONFIDENTIAL(?: [A-Z]+)+|Record of [A-Z]\w+(?: [A-Z]\w+)*|[A-Z][\w' -]+ No\. \d+)$")


@lru_cache(8192)
def _bare(s: str) -> str:
    if "  " not in s and not any(map(str.isdigit, s)):
        return s
    return " ".join(x for x in _PART.split(s) if not (_PAGE.match(x) or _STAMP.match(x)))
