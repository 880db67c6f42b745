"""Reading the parts of a name and of an address: titles and affiliations off, first names and short forms, surname, middle initial."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: First names and their usual short forms: fixed values, common knowledge.
SHORT_FORMS = {
    "abigail": "abby", "anthony": "tony", "barbara": "barb", "benjamin": "ben", "carl": "", "carla": "", "charles": "chuck charlie", "christopher": "chris", "daniel": "dan danny", "danielle": "dani",
    "deborah": "deb debbie", "denis": "", "denise": "", "dorothy": "dot dottie", "edward": "ed eddie", "elizabeth": "beth liz betty", "eric": "", "erica": "", "eugene": "gene", "frederick": "fred", "gabriel": "gabe",
    "gregory": "greg", "harold": "hal harry", "helen": "", "ingrid": "", "isabel": "izzy", "james": "jim jimmy", "jeffrey": "jeff", "jennifer": "jenny jen", "jonathan": "jon", "joseph": "joe", "judith": "judy",
    "katherine": "kate kathy", "kenneth": "ken", "lawrence": "larry", "leonard": "len", "louise": "lou", "margaret": "maggie peggy meg", "matthew": "matt", "michael": "mike", "nathaniel": "nate", "nicholas": "nick", "oscar": "",
    "pamela": "pam", "patricia": "trish pat patty", "paul": "", "paula": "", "philip": "phil", "quentin": "", "raymond": "ray", "rebecca": "becky", "richard": "rick dick", "robert": "bob rob bobby", "ronald": "ron", "samuel": "sam",
    "sandra": "sandy", "stephen": "steve", "susan": "sue", "theodore": "ted theo", "thomas": "tom", "timothy": "tim", "ursula": "", "victoria": "vicky", "vincent": "vince", "walter": "walt", "william": "will bill", "yvonne": "", "zachary": "zach",
}
FULL = {n: n for n in SHORT_FORMS} | {s: n for n, x in SHORT_FORMS.items() for s in x.split()}
#: Words that make a name an organisation's, and role words in addresses: fixed values.
ORG_WORDS = frozenset("works institute association council services svcs board company laboratory authority partners network agency bureau llc inc ltd co corp group office county water chemical chem mining research testing farmers legal assoc inst lab".split())
ORG_ENDS = frozenset("llc inc ltd co corp the of".split())
ROLES = frozenset("info contact office desk docket mail admin".split())

_TITLE = re.compile(r"^(?:dr|prof|mr|mrs|ms|miss|sir|hon)\b\.?\s*", re.I)
_TAIL = re.compile(r"\s*(?:/\w+|\([^)]*\)|\[[^\]]*\]|\s-\s.*)\s*$")
_DIGITS = str.maketrans("0156893", "olsbbge")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """Longest-common-subsequence ratio."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


_NEAR: dict[str, str | None] = {}


def first_name(word: str) -> str | None:
    """The full first name a word stands for: itself, a short form, or a damaged spelling of five letters or more nearest to it."""
    if word in FULL:
        return FULL[word]
    if word not in _NEAR:
        if len(_NEAR) > 200_000:
            _NEAR.clear()
        best, at = 0.0, None
        if len(word) >= 4:
            for n in SHORT_FORMS:
                if abs(len(n) - len(word)) <= 2 and len(n) >= 4 and (r := ratio(word, n)) > best:
                    best, at = r, n
        _NEAR[word] = at if best >= 0.8 else None
    return _NEAR[word]


@dataclass
class Parts:
    first: str | None = None  # full first name
    initial: str | None = None
    middle: str | None = None
    last: str | None = None
    org: str | None = None  # initials of the words that make it an organisation
    exact: bool = True  # first name spelt as it is known
    raw: str | None = None  # first name as written


def read_name(name: str | None) -> Parts | None:
    """The parts of a display name; null if it has no word of three letters or more."""
    if not name:
        return None
    s = name.strip()
    while (t := _TAIL.sub("", s)) != s and t:
        s = t
    while (t := _TITLE.sub("", s)) != s and t:
        s = t
    words = [w for w in re.split(r"[\s,.]+", s) if w]
    low = [re.sub(r"[^a-zà-ÿ]", "", w.lower().translate(_DIGITS)) for w in words]
    upper = [w.isupper() and len(w) == 2 for w in words]
    if all(w in ROLES for w in low if w):
        return Parts(last="".join(low), org="role") if any(low) else None
    if any(w in ORG_WORDS for w in low) or (any(upper) and sum(w not in ORG_ENDS for w in low) == 2):
        return _org([w for w in low if w], [w.lower() for w, u in zip(words, upper) if u])
    # A part in lower case after one with a capital was torn off it.
    joined: list[str] = []
    for raw, w in zip(words, low):
        if not w:
            continue
        if joined and raw[0].islower() and len(words) > 2 and not name.islower():
            joined[-1] += w
        else:
            joined.append(w)
    single = [w for w in joined if len(w) == 1]
    long = [w for w in joined if len(w) > 1]
    p = Parts()
    if not long:
        return None
    firsts = [(w not in FULL, i, w) for i, w in enumerate(long) if first_name(w)]
    if len(long) >= 2 and firsts:
        _, i, w = min(firsts)
        p.first, p.exact, p.raw = first_name(w), w in FULL, w
        rest = long[:i] + long[i + 1 :]
        p.last = "".join(rest)
        p.initial = p.first[0]
        p.middle = single[0] if single else None
    elif len(long) == 1:
        p.last = long[0]
        p.initial = single[0] if single else None
        p.middle = single[1] if len(single) > 1 else None
    else:  # no listed first name: the parts by their place, the surname last or before a comma
        k = sum(1 for w in re.split(r"[\s.]+", s.partition(",")[0]) if len(re.sub(r"[^a-zà-ÿ]", "", w.lower().translate(_DIGITS))) > 1) if "," in s else 0
        k = k if 0 < k < len(long) else 0
        p.last, p.raw = ("".join(long[:k]), long[k]) if k else (long[-1], long[0])
        p.initial = p.raw[0]
        p.middle = single[0] if single else None
    return p if p.last and len(p.last) >= 3 else None


def org_word(w: str) -> bool:
    """Whether a word, or two run together, makes a name an organisation's."""
    return w in ORG_WORDS or any(w[:k] in ORG_WORDS and w[k:] in ORG_WORDS for k in range(3, len(w) - 2))


def _head(w: str) -> str:
    """A head word without an organisation's word run together with it."""
    for o in ORG_WORDS:
        if len(o) >= 5 and len(w) >= len(o) + 5:
            if w.endswith(o):
                return w[: -len(o)]
            if w.startswith(o):
                return w[len(o) :]
    return w


def _org(low: list[str], caps: list[str]) -> Parts | None:
    kind = [w for w in low if w in ORG_WORDS and w not in ORG_ENDS]
    head = [_head(w) for w in low if not org_word(w) and w not in ORG_ENDS and w not in caps and len(w) > 3 and not any(ratio(w, o) >= 0.8 for o in ORG_WORDS if len(o) > 4)]
    if not head:
        return None
    return Parts(last=max(head, key=len), org="".join(w[0] for w in kind)[:2] or (caps[0] if caps else ""))


def read_local(local: str, hint: Parts | None = None) -> Parts | None:
    """The parts of an address before the @; ``hint``, the parts of the name beside it, settles where run-together words divide."""
    s = re.sub(r"^(?:mailto|to)[-.:]", "", local.lower())
    words = [re.sub(r"^\d+|[^a-zà-ÿ]", "", w.translate(_DIGITS) if not w[:1].isdigit() else w.lstrip("0123456789").translate(_DIGITS)) for w in re.split(r"[._\-+]+", s)]
    words = [w for w in words if w]
    if not words:
        return None
    if (hint and hint.org is not None) or any(w in ROLES or org_word(w) or _head(w) != w for w in words):
        head = [_head(w) for w in words if w not in ROLES and not org_word(w) and len(w) > 3]
        return Parts(last=max(head, key=len), org="") if head else None
    single = [w for w in words if len(w) == 1]
    long = [w for w in words if len(w) > 1]
    p = Parts()
    firsts = [(w not in FULL, i, w) for i, w in enumerate(long) if first_name(w)]
    if len(long) >= 2 and firsts:
        _, i, w = min(firsts)
        p.first, p.exact, p.raw = first_name(w), w in FULL, w
        p.initial = p.first[0]
        p.last = "".join(long[:i] + long[i + 1 :])
        p.middle = single[0] if single else None
        return p
    if not long:
        return None
    whole = "".join(long)
    p.initial = single[0] if single else None
    if hint and hint.last and hint.org is None:
        if ratio(whole, hint.last) >= 0.9 and len(whole) - len(hint.last) < 1:
            p.last = whole
            return p
        if hint.initial and len(whole) > 5 and not single:
            for first, last in ((whole[0], whole[1:]), (whole[-1], whole[:-1])):
                if first == hint.initial and ratio(last, hint.last) >= 0.8 and abs(len(last) - len(hint.last)) <= 1:
                    p.initial, p.last = first, last
                    return p
    for n in sorted(FULL, key=len, reverse=True):
        if len(n) >= 3 and len(whole) >= len(n) + 5:
            for last, at in ((whole[len(n) :], whole.startswith(n)), (whole[: -len(n)], whole.endswith(n))):
                if at and (len(n) >= 5 or (hint and hint.last and ratio(last, hint.last) >= 0.8)):
                    p.first, p.initial, p.last = FULL[n], FULL[n][0], last
                    return p
    for w in long[:1]:  # a first name with the middle initial behind it
        if len(long) >= 2 and w[:-1] in FULL:
            return Parts(first=FULL[w[:-1]], initial=FULL[w[:-1]][0], middle=w[-1], last="".join(long[1:]))
    if len(long) >= 2 and long[-1][:-1] in FULL:
        return Parts(first=FULL[long[-1][:-1]], initial=FULL[long[-1][:-1]][0], middle=long[-1][-1], last="".join(long[:-1]))
    p.last = whole
    return p
