"""Rule tables of the address normalisers. Every table is a parameter of the function that uses it; these are the defaults."""

from __future__ import annotations

import json
from pathlib import Path

# Misread forms of the agency's mail domain that the network build maps to it.
AGENCY = "epa.gov"
AGENCY_VARIANTS_BUILD = """
epa.govl epa.qov epa.qovl epa.goy epa.aov epa.aovl epa.gqv epa.rov epa.rovl epa.fiov epa.giov epa.g0v ep3.gov ep3.govl cpa.gov cpa.govl
cp3.gov epa.qoy epa.aoyl epa.goyl epa.gov1 epamail.epa.gov epa.flov epa.gqvl epa.qqv epa.gq epa.govcmai epa.eov epa.gqyl epa.rgv epa.go
epa.govemai epa.oov epa.oovl epa..gov epa.uo epa.qo epa.ggy epa.qqvl epa.gqy epa.gm epa.govt epa.ggv epa.rqv epa.qqyl epa.sov epa.flovl
epa.rovj epa.gqvi epa.jtov epa.goto epa.rqy epa.governai epa.aoy epa.ciov epa.qoyl epa.qovy epa.ggyl epa.govj epa..gqv epa.rev epa.gev
epa.p.ov epa.g.qy epa.gow epa.qqy epa.qol -epa.gov 1epa.gov 1lepa.gov 11epa.gov gepa.gov jepa.gov epamail.gov domino.epamail.epa.gov
usepa.onmicrosoft.com
""".split() + ["epa.go v"]

# The further forms that only the deduplication maps to it.
AGENCY_VARIANTS_MORE = """
cpa.gqy cpa.go cpa.goy cpa.goyl cpa.ggy cpa.gm cpa.gg cpa.g.qy cpa.gcn cpa.qov cpa.aov cp3.govl cp3.goy cp3.qov ilepa.gov ljcpa.gov qa.gov
epama.il
""".split()

# State agencies that keep their own domain.
STATE_AGENCIES_BUILD = {"iepa.gov": "iepa.gov", "ilepa.gov": "iepa.gov", "calepa.ca.gov": "calepa.ca.gov"}
STATE_AGENCIES = ("iepa.gov", "calepa.ca.gov")

# Single repairs of the network build, and endings it takes for ".gov".
BUILD_REPAIRS = {"b1m.gov": "blm.gov", "govl": "gov"}
BUILD_ENDINGS = ("qov", "aov", "goy", "rov")

# Last labels and what they are misread from, in the deduplication.
LAST_LABELS = {
    "qov": "gov", "aov": "gov", "goy": "gov", "rov": "gov", "sov": "gov", "eov": "gov", "oov": "gov", "fiov": "gov", "gow": "gov", "gcn": "gov", "gq": "gov", "gqy": "gov", "ggy": "gov", "gg": "gov",
    "eom": "com", "corn": "com", "coml": "com", "comi": "com", "orq": "org", "orql": "org", "ora": "org", "ore": "org", "orgl": "org", "edul": "edu",
}

#: Whole-domain repairs of the deduplication. The generic ones stand here; a deployment passes its own table of organisations.
DOMAIN_REPAIRS = {
    "b1m.gov": "blm.gov", "qmail.com": "gmail.com", "gmial.com": "gmail.com", "grnail.com": "gmail.com", "grnall.com": "gmail.com", "qrnail.com": "gmail.com", "gmai1.com": "gmail.com", "gmaii.com": "gmail.com", "maii.mil": "mail.mil",
}

# Character confusions, applied in this order.
DOMAIN_CHARACTERS = (("rn", "m"), ("1", "l"), ("3", "a"), ("0", "o"), ("v", "y"))
LOCAL_CHARACTERS = (("ffl", "m"), ("ffi", "n"), ("rn", "m"), ("ii", "n"), ("v", "y"), ("1", "l"), ("0", "o"), ("3", "a"))
DISPLAY_INNER = (("1", "l"), ("0", "o"), ("3", "e"), ("8", "b"), ("5", "s"), ("6", "b"), ("2", "z"))
DISPLAY_FIRST = (("3", "e"), ("1", "l"), ("0", "o"), ("5", "s"), ("6", "b"))

# Fixed value: ways a "mailto:" before an address is misread.
MAILTO = r"^(?:[rfnc]?mailto[i1l:;c]\s*|[rfnc]?rnailto[i1l:;c]\s*|[rfnc]?rnai[il1]to[i1l:;c]\s*|[rfnc]?mai[il1]to[i1l:;c]\s*|mail\.to[i1l:;c]\s*|[rfnc]?mailtcr\s*|[rfnc]?mai[il1]sto[i1l:;c]\s*|[1l]to[i1l:;c]\s*)"

# Header and address patterns.
ADDRESS = r"[a-zA-Z0-9][a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+\.(?:com|net|org|edu|gov|mil|co|io|me|info|biz)"
MAILBOX = r"[a-zA-Z0-9][a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+\.[a-z]{2,}"
FROM_NAMED = rf"From:\s*([^<\n]*?)\s*<?({MAILBOX})>?"
FROM_BARE = (rf"Author:\s*({MAILBOX})", rf"Sent by:\s*({MAILBOX})")
TO_NAMED = (rf"(?:^|\n)\s*To:\s*([^<\n]*?)\s*<?({MAILBOX})>?", rf"(?:^|\n)\s*TO:\s*([^<\n;]*?)\s*<?({MAILBOX})>?")
CC_NAMED = rf"(?:^|\n)\s*CC?:\s*([^<\n]*?)\s*<?({MAILBOX})>?"
TO_LINE, CC_LINE = r"(?:To|TO):([^\n]*)", r"(?:Cc|CC):([^\n]*)"

# What shows that a display name is a piece of a header.
NAME_GARBAGE = "sent: mailto: subject: to: from: cc: monday tuesday wednesday thursday friday saturday sunday @ january february march april may june july august september october november december".split() + ["am to:", "pm to:"]

#: Single-word local parts that name a role and no person. Loadable, like the first names below.
GENERIC_LOCALS = frozenset("info admin contact office sales support help news mail webmaster press media hr jobs team staff service services billing events desk docket records library research".split())
#: First names; a deployment passes its own list.
FIRST_NAMES = frozenset(
    "abigail anthony barbara benjamin carl carla charles christopher daniel danielle deborah denis denise dorothy edward elizabeth eric erica eugene frederick gabriel gregory harold helen ingrid isabel james jeffrey jennifer jonathan joseph judith katherine kenneth lawrence leonard louise margaret matthew michael nathaniel nicholas oscar pamela patricia paul paula philip quentin raymond rebecca richard robert ronald samuel sandra stephen susan theodore thomas timothy ursula victoria vincent walter william yvonne zachary john mary david linda mark karen george nancy brian lisa kevin sarah scott amy".split()
)
#: Domains that write the last name first.
LAST_NAME_FIRST = frozenset(["epa.gov"])


def load(path: str) -> dict:
    """A deployment's tables from a JSON file: ``address_repairs`` and ``domain_repairs`` (objects from bad to good, added to those that stand here),
    ``generic`` and ``first_names`` (lists, in place of those). The result goes to the resolution as keyword arguments; other keys are an error."""
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    if extra := set(given) - {"address_repairs", "domain_repairs", "generic", "first_names"}:
        raise ValueError(f"unknown tables: {sorted(extra)}")
    out: dict = {"address_repairs": dict(given.get("address_repairs", {})), "domain_repairs": DOMAIN_REPAIRS | given.get("domain_repairs", {})}
    for name in ("generic", "first_names"):
        if name in given:
            out[name] = frozenset(map(str.lower, given[name]))
    return out
