"""Ordered repairs of scanned text. Patterns and replacements, in the order in which they apply."""

from __future__ import annotations

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
HYPHEN_BREAK = (r"(\w{2,})-\s*\n\s*(\w{2,})", "$1$2")
SPACES = ("  +", " ")
MISSING_SPACE = ("([.!?])([A-Z])", "$1 $2")

# Broken common words: the pieces as they stand; all in any case but the two of CASED.
BROKEN_WORDS = """
th e|t he|a nd|an d|w ith|wi th|o f|t o|i n|i s|w as|ha ve|h ave|be en|b een|fr om|f rom|th at|tha t|th is|thi s|wer e|w ere|whe n|w hen|whi ch|w hich|the ir|th eir|wou ld|w ould|cou ld|c ould|shou ld|sh ould|abo ut|ab out|the se|th ese|the re|th ere|whe re|w here|of f
""".strip().split("|")
CASED = ("i n", "i s")

# Broken endings of words.
BROKEN_ENDINGS = "in g|i ng|tio n|ti on|t ion|me nt|m ent|men t|ne ss|n ess|nes s|ly".split("|")

# Character confusions, whole words. "any": in any case.
CONFUSIONS = """
tbe the
Tbe The
TBE THE
tlie the
Tlie The
tiie the
Tiie The
wlien when
Wlien When
whicli which
Whicli Which
witli with
Withi With
otlier other
Otlier Other
liave have
Liave Have
liis his
Liis His
shcrwin sherwin any
thc the
Thc The
THC THE
lcvcl level any
lcvcm level any
rnay may
Rnay May
rnust must
Rnust Must
rnore more
Rnore More
rnake make
Rnake Make
frorn from
Frorn From
sarne same
Sarne Same
tiine time
Tiine Time
narnes names
Narnes Names
nurnber number
Nurnber Number
responsibi1ity responsibility any
capab1e capable any
appreciab1y appreciably any
isn1t isn't any
conftdfnttal confidential any
conftdential confidential any
confldential confidential any
confidcntial confidential any
ofthe of_the
ofthis of_this
ofthese of_these
inthe in_the
tothe to_the
forthe for_the
andthe and_the
onthe on_the
atthe at_the
""".strip().splitlines()

LIGATURES = ((r"\bf i(\w+)\b", "fi$1"), (r"\bf l(\w+)\b", "fl$1"), (r"(\w)f f(\w)", "$1ff$2"))


def cleaning_rules() -> list[tuple[str, str, str, str]]:
    """(statistic, Java pattern, replacement, needle) of every rule that works by replacement, in order. The needle is a lower-case string without which
    the pattern cannot match; it is empty where there is none."""
    out = [("control_chars_removed", CONTROL, "", ""), ("hyphen_breaks_fixed", "(?U)" + HYPHEN_BREAK[0], HYPHEN_BREAK[1], "-")]
    for w in BROKEN_WORDS:
        whole = w.replace(" ", "")
        out.append((f"broken_word_{whole}", rf"(?U{'' if w in CASED else 'i'})\b{w}\b", whole, w))
    for e in BROKEN_ENDINGS:
        out.append(("broken_suffixes_fixed", rf"(?U)\b(\w{{2,}}){e}\b", "$1" + e.replace(" ", ""), e))
    for line in CONFUSIONS:
        bad, good, *any_ = line.split()
        good = good.replace("_", " ")
        out.append((f"char_fix_{good}", rf"(?U{'i' if any_ else ''})\b{bad}\b", good, bad.lower()))
    out += [("ligatures_fixed", "(?U)" + p, r, n) for (p, r), n in zip(LIGATURES, ("f i", "f l", "f f"))]
    return [*out, ("multi_spaces_fixed", *SPACES, "  "), ("missing_spaces_added", *MISSING_SPACE, "")]
