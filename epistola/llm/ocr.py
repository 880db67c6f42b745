"""Problem 4: repairing text from scanned pages.

1. All running words of the corpus are counted, and how often each stands in texts that show no trace of a page. Words whose share there is like the
   corpus's are sound; they are the words that others may be read as.
2. Every word that is not plainly sound looks for what it might be misread from: a join on character q-grams with the sound words retrieves candidates, and
   two sound words run together are found by a join on split positions. Gradient-boosted trees rank the candidates by counts, shapes and the share in
   typed texts; they are trained on sound words damaged the way a scanner damages them.
3. One pass over the texts: a boosted classifier over lines and their neighbours, trained on typed texts with page breaks planted in them, finds
   page furniture; another over pairs of lines decides on the hyphen of words torn at a line end; and every word that is not a clean
   lexicon word asks the ranked corrections, in a join.

Counts and corrections are tables of any size. Only the ``LEXICON`` most frequent sound words are sent to the tasks, as a shortcut: words beyond them
are looked up in the tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import inf
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epistola.llm.boosting import Boosted
from epistola.llm.furniture import _CAPTION, _NUMBER, furniture_lines, is_stamp, running, shape, title_like
from epistola.session import Scratch

#: Most words sent to the tasks, least count of a sound word, and training bounds: damaged words a model and documents for the line model.
LEXICON, LEAST, TRAIN_WORDS, TRAIN_DOCUMENTS = 50_000, 5, 6_000, 400
#: A word is a fragment or a misreading only if it is this much rarer than the word it is read as.
RARER = 25.0
#: A word is sound if its share in texts that show no trace of a page is at least so much of all words' share. With ``PLAIN`` occurrences
#: there it is plainly so and no misreading; with fewer the ranking weighs the share.
SOUND, PLAIN = 0.55, 3
#: The share of a damaged word's occurrences that training puts in texts without a trace: scans that show none.
UNTRACED = 0.07
#: A misreading of one word is looked for down to this ratio of counts; the ranking weighs how far it is below.
RARE = 4.0
ACCEPT = 0.5

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*(?:-[^\W_]+(?:['’][^\W_]+)*)*")
_QUOTE = re.compile(r"^[\s>|]+")
_TORN = re.compile(r"([^\W\d_][^\W_]*)(-|\xad|¬)\s*$")
_GAP = re.compile(r"[.!?:][\"'”’)\]]*\s")
_AFTER = re.compile(r"\s*([^\W_]+(?:['’-][^\W_]+)*)")
_BEFORE = re.compile(r"([^\W_]+-)$")
_HYPHENS = frozenset("-\xad¬")
_HEAD = re.compile(r"^\W{0,3}(?:from|author|sent by|to|cc|c|date|sent|subject|fw|re)\s*:", re.I)
_STOP = re.compile(r"[.!?:][\"'”’)\]]*\s*$")

#: What scanners confuse, as printed and as read: fixed values.
CONFUSIONS = [("a", "o"), ("b", "6"), ("c", "e"), ("cl", "d"), ("d", "cl"), ("e", "c"), ("fi", "\ufb01"), ("fl", "\ufb02"), ("g", "9"), ("g", "q"), ("h", "b"), ("b", "h"), ("i", "1"), ("i", "l"), ("in", "m"), ("l", "1"), ("l", "i"), ("li", "h"), ("h", "li"), ("m", "rn"), ("n", "ri"), ("n", "u"), ("o", "0"), ("o", "a"), ("r", "i"), ("ri", "n"), ("rn", "m"), ("s", "5"), ("t", "f"), ("f", "t"), ("ti", "d"), ("u", "ii"), ("u", "n"), ("v", "y"), ("vi", "w"), ("w", "vv"), ("z", "2")]
_CONFUSED = frozenset(CONFUSIONS)


def confusions(word: str, source: str) -> int:
    """1 if a word is its source with one scanner's confusion, 2 with two apart from each other, else 9."""
    i, n = 0, min(len(word), len(source))
    while i < n and word[i] == source[i]:
        i += 1
    j = 0
    while j < n - i and word[-1 - j] == source[-1 - j]:
        j += 1
    a, b = source[i : len(source) - j], word[i : len(word) - j]
    # The parts that differ may share letters with what surrounds them ("rn" for "n" after an "r").
    for left in range(2):
        for right in range(2):
            x = (source[i - left : i] + a + source[len(source) - j : len(source) - j + right], word[i - left : i] + b + word[len(word) - j : len(word) - j + right])
            if x in _CONFUSED:
                return 1
    for p in range(1, min(3, len(a))):
        for q in range(1, min(3, len(b))):
            if (a[:p], b[:q]) in _CONFUSED:
                for r in range(1, 3):
                    for t in range(1, 3):
                        if (a[-r:], b[-t:]) in _CONFUSED and a[p : len(a) - r] == b[q : len(b) - t] and p + r <= len(a) and q + t <= len(b):
                            return 2
    return 9


def fold(word: str) -> str:
    """A word with the usual confusions undone in one direction, so that a misreading and its source often fold alike."""
    for a, b in (("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "n"), ("vv", "w"), ("li", "h"), ("1", "l"), ("i", "l"), ("0", "o"), ("5", "s"), ("6", "b"), ("b", "h"), ("c", "e"), ("a", "o"), ("f", "t"), ("q", "g"), ("u", "n"), ("y", "v")):
        word = word.replace(a, b)
    return word


def distance(a: str, b: str) -> int:
    """Edit distance with neighbours swapped as one edit."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, last = last, now
    return last[-1]


def text_lines(lines: list[str], drop: set[int]) -> list[tuple[int, str]]:
    """(index, line without quote marks) of running text: paragraphs that hold a running line, without furniture, headers and addresses."""
    out, block = [], []
    for k, x in enumerate([*lines, ""]):
        if k in drop:
            continue
        if x[:1] in " \t>|" and x:
            x = _QUOTE.sub("", x)
        if x and not x.isspace():
            block.append((k, x))
        elif block:
            if any(len(x) >= 64 and "@" not in x or running(x) for _, x in block):
                out += [(i, x) for i, x in block if "@" not in x and not _HEAD.match(x)]
            block = []
    return out


_WORDS = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_FIRST = re.compile(r"(?:^|[.!?:][\"'”’)\]]*\s+|\n\s*\n[\s>|]*)([A-ZÀ-Þ][a-zß-öø-ÿ\ufb01\ufb02]*(?:['’-][^\W_]+)*)")
_MAILBOX = re.compile(r"\S+@\S+")


#: A text with a word torn at a line end comes from a page; a page number or stamp on a line of its own says the same.
_TEAR = re.compile(r"[-\xad¬](?<=[^\W\d_].) ?\n[\s>|]*[^\W\d_]")
_STAMPED = re.compile(r"\f|\n(?:[\s>|]*(?:[pP]\.|[pP]g\.|[pP]age) ?\d+[^\n]{0,9}\n|[\[(-] ?\d+ ?[\])-]\n|Exhibit [^\n]{1,8}\n|[A-Z]{2,5}-?\d{4,}\n|[A-Z][^\na-z]{3,40} NO\. *\d+\n)")


#: The same for the choice of typed texts to train on.
_TRACE = r"[-\xad¬] ?\n|\f|\n[\s>|]*[pP](?:\.|g\.|age) ?\d|\n[\[(-] ?\d+ ?[\])-]\n"


def paged(text: str) -> bool:
    return _TEAR.search(text) is not None or _STAMPED.search(text) is not None


#: Lines that consist of a page number, a stamp or a caption, first and last ones included.
_MARKED = re.compile(
    r"^\W{0,3}(?:p(?:age|g|p)?[.,]?\s*\d{1,4}\b[^\n]{0,9}|\d{1,3}\s*(?:of|/)\s*\d{1,3}\W{0,3})$|^\s*[A-Z][A-Z0-9]{1,5}[- ]?(?:[\dlIOoSB]{4}-)?[\dlIOoSB]{4,9}\s*$|"
    r"^[^\na-z]{3,40} NO\.?\s+\d+|^(?:Exhibit [A-Z0-9]{1,3}-\d|CONFIDENTIAL [A-Z]|Record of [A-Z])|^[A-Z][^\n]{2,40} No\. \d+\s*$",
    re.M,
)


def hinted(text: str, lines: list[str]) -> bool:
    """Whether a text without a plain trace of a page may hold furniture after all: a line that looks like it, or a short one that recurs."""
    if _MARKED.search(text):
        return True
    short = [x for x in lines if 4 < len(x) < 60 and x[0].isupper() and x[-1] != ","]
    return len(set(short)) < len(short)


def _counter(batches):
    """Partial counts of words, and of their occurrences in texts without a trace of a page: misreadings have hardly any."""
    seen: Counter = Counter()  # by token; the words in a token are found once, when the counts go out
    typed: Counter = Counter()
    first: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for text in b.column(0).to_pylist():
            page = paged(text)
            (seen if page else typed).update(text.split())
            first[page].update(_FIRST.findall(_MAILBOX.sub(" ", text) if "@" in text else text))
        if len(seen) + len(typed) > 500_000:
            yield _counted(seen, typed, first)
            seen, typed, first = Counter(), Counter(), (Counter(), Counter())
    yield _counted(seen, typed, first)


def _counted(seen: Counter, typed: Counter, first: tuple[Counter, Counter]) -> pa.RecordBatch:
    """Words in lower case, and those that begin a sentence."""
    all_: Counter = Counter()
    plain: Counter = Counter()
    for tokens, begin, out in ((seen, first[1], (all_,)), (typed, first[0], (all_, plain))):
        for token, n in tokens.items():
            for w in _WORDS.findall(_MAILBOX.sub(" ", token) if "@" in token else token):
                for c in out:
                    c[w] += n
        for w, n in begin.items():
            for c in out:
                c[w.lower()] += n
    words = [w for w in all_ if w[0].islower() or (w[0].isdigit() and any(c.islower() for c in w))]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([all_[w] for w in words], pa.int64()), pa.array([plain[w] for w in words], pa.int64())], names=["w", "n", "typed"])


def _size(length):
    return F.when(length <= 5, 2).otherwise(3)


def _grams(column: str, sizes=None):
    """Distinct q-grams of a padded word: pairs for words of up to five letters, triples for others, or those of the sizes given."""
    w = F.concat(F.lit("^"), F.col(column), F.lit("$"))
    of = lambda q: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - q + 1, F.lit(1))), lambda i: F.substring(w, i, q))
    return F.array_distinct(of(_size(F.length(column))) if sizes is None else F.flatten(F.array(*[of(F.lit(q)) for q in sizes])))


def near(w: str, c: str) -> bool:
    """Whether w may be c misread: one edit in short words, two in others, or what a scanner confuses, twice in words of six letters or more."""
    return distance(w, c) <= (1 if len(w) <= 4 else 2) or confusions(w, c) <= (2 if len(w) >= 6 else 1)


def features(w: str, n: float, typed: float, c: str, m: float, best: float, many: int) -> list[float]:
    """What the ranking sees of word w (count n; typed: its share in texts without a trace, as a multiple of all words') and candidate c (count m);
    best: the greatest count among its candidates."""
    d = distance(w, c)
    fw, fc = fold(w), fold(c)
    return [np.log1p(n), np.log1p(m), np.log((m + 1) / (n + 1)), d, distance(fw, fc), len(w), len(w) - len(c), d / max(len(w), len(c)), w[0] == c[0], w[-1] == c[-1], any(x.isdigit() for x in w), np.log((m + 1) / (best + 1)), many, confusions(w, c), "-" in w, "-" in c, typed]


def damage(word: str, rng: Random) -> str:
    """A word as a scanner might read it: one confusion, now and then two, rarely some other letter."""
    for _ in range(1 + (rng.random() < 0.15)):
        able = [(a, b) for a, b in CONFUSIONS if a in word]
        if able and rng.random() < 0.99:
            a, b = rng.choice(able)
            at = rng.choice([m.start() for m in re.finditer(re.escape(a), word)])
            word = word[:at] + b + word[at + len(a) :]
        else:
            k = rng.randrange(len(word))
            word = word[:k] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[k + 1 :]
    return word


class _Index:
    """The q-gram index of the lexicon, for training."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon, self.post = lexicon, {}
        for w in lexicon:
            for g in self.grams(w, 2) | self.grams(w, 3):
                self.post.setdefault(g, []).append(w)

    @staticmethod
    def grams(w: str, q: int) -> set[str]:
        p = f"^{w}$"
        return {p[i : i + q] for i in range(max(1, len(p) - q + 1))}

    def candidates(self, w: str) -> list[str]:
        hits = Counter(c for g in self.grams(w, 2 if len(w) <= 5 else 3) for c in self.post.get(g, ()))
        return [c for c, k in hits.items() if c != w and abs(len(c) - len(w)) <= 2 and k * 3 >= len(w) - 2 and near(w, c)]


def share_of(typed: float, n: float, share: float) -> float:
    """A word's share in texts without a trace as a multiple of all words' share, drawn to one where the word is rare."""
    return (typed + 0.5) / (n * share + 0.5)


def train_ranker(lexicon: dict[str, int], share: float) -> Boosted:
    """The ranking model: damaged lexicon words, with the counts such damage would have, against their candidates; and lexicon words as they are."""
    rng, index = Random(7), _Index(lexicon)
    pool = sorted(w for w, n in lexicon.items() if len(w) >= 2 and n >= LEAST * RARER and w.isalpha())
    drawn = lambda n, p: sum(rng.random() < p for _ in range(n)) if n < 200 else round(n * p)
    x, y = [], []
    for k in range(TRAIN_WORDS if pool else 0):
        true = pool[rng.randrange(len(pool))]
        if k % 3 == 0:  # a sound word, as rare as a sound word may be
            w, n, true = true, max(1, int(lexicon[true] * 10 ** rng.uniform(-3.5, 0))), None
            typed = drawn(n, share)
        else:
            w = damage(true, rng)
            n = max(1, int(lexicon[true] * 10 ** rng.uniform(-4.5, -0.7)))
            typed = drawn(n, UNTRACED * share)
            if w == true or w in lexicon and lexicon[w] > n:
                continue
        found = [c for c in index.candidates(w) if lexicon[c] > RARE * n]
        best = max((lexicon[c] for c in found), default=0)
        for c in found:
            x.append(features(w, n, share_of(typed, n, share), c, lexicon[c], best, len(found)))
            y.append(c == true)
    if sum(y) < 20:  # no corpus to learn from: nothing is ever replaced
        return Boosted(base=-9.0, edges=[np.zeros(0)] * 17)
    return Boosted(rounds=80).fit(np.array(x), np.array(y))


def _near(batches):
    for b in batches:
        ok = pa.array([near(w, c) for w, c in zip(b.column(0).to_pylist(), b.column(3).to_pylist())], pa.bool_())
        yield b.filter(ok)


def _ranked(model: Boosted, share: float):
    def run(batches):
        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in range(7))))
            x = [features(w, n, share_of(typed, n, share), c, m, best, many) for w, n, typed, c, m, best, many in rows]
            s = model.score(np.array(x)) if x else np.zeros(0)
            good = [(r[0], r[3], p) for r, p in zip(rows, s) if p >= ACCEPT]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["w", "c", "p"])

    return run


def corrections(vocabulary: DataFrame, model: Boosted, share: float) -> DataFrame:
    """``w, c``: words of the corpus and what should stand there, one word or two with a blank between. ``vocabulary``: ``w, n, typed, sound``."""
    lex = vocabulary.where("sound").select(F.col("w").alias("c"), F.col("n").alias("m"))
    v = vocabulary.where((F.length("w") >= 2) & ~(F.col("sound") & (F.col("typed") >= PLAIN)))
    left = v.select("w", "n", "typed", F.explode(_grams("w")).alias("g"))
    # A misreading may be up to two letters longer or shorter than its word, so words near the border have q-grams of both sizes.
    right = lex.where(F.length("c") >= 2).select("c", "m", F.explode(F.when(F.length("c") <= 3, _grams("c", (2,))).when(F.length("c") <= 7, _grams("c", (2, 3))).otherwise(_grams("c", (3,)))).alias("g"))
    able = (F.abs(F.length("w") - F.length("c")) <= 2) & (F.col("m") > RARE * F.col("n"))
    pairs = left.join(right.hint("merge"), "g").where(able).groupBy("w", "c").agg(F.first("n").alias("n"), F.first("typed").alias("typed"), F.first("m").alias("m"), F.count(F.lit(1)).alias("hits"))
    # The edit distance bounds what the closer look may accept, and runs in the JVM.
    pairs = pairs.where((F.col("hits") * 3 >= F.length("w") - 2) & (F.levenshtein("w", "c") <= F.when(F.length("w") >= 6, 4).otherwise(2)))
    pairs = pairs.select("w", "n", "typed", "c", "m").mapInArrow(_near, "w string, n long, typed long, c string, m long")
    own = Window.partitionBy("w")
    pairs = pairs.withColumn("best", F.max("m").over(own)).withColumn("many", F.count(F.lit(1)).over(own))
    ranked = pairs.select("w", "n", "typed", "c", "m", "best", "many").mapInArrow(_ranked(model, share), "w string, c string, p double")
    one = ranked.groupBy("w").agg(F.max(F.struct("p", "c")).alias("b")).select("w", F.col("b.c").alias("c"), F.lit(0).alias("kind"))
    cut = v.where(F.length("w") >= 5).select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i"))
    cut = cut.select("w", "n", F.expr("substring(w, 1, i)").alias("a"), F.expr("substring(w, i + 1)").alias("b"))
    parts = lex.where((F.length("c") >= 3) | F.col("c").isin("a", "an", "as", "at", "be", "by", "in", "is", "it", "no", "of", "on", "or", "to", "we", "if", "he", "my"))
    pa_, pb = (parts.select(F.col("c").alias(x), F.col("m").alias(f"m{x}")).hint("merge") for x in "ab")
    two = cut.join(pa_, "a").join(pb, "b").where(F.least("ma", "mb") > RARER * F.col("n"))
    two = two.groupBy("w").agg(F.max(F.struct(F.least("ma", "mb").alias("m"), F.concat_ws(" ", "a", "b").alias("c"))).alias("b")).select("w", F.col("b.c").alias("c"), F.lit(1).alias("kind"))
    return one.unionByName(two).groupBy("w").agg(F.min(F.struct("kind", "c")).alias("b")).select("w", F.col("b.c").alias("c"))


# --- lines ---------------------------------------------------------------------------------------------------------------


def separator(line: str) -> bool:
    """Whether a line in dashes stands between mails, and is no page number in dashes."""
    return line.startswith("---") and not is_stamp(line)


def line_features(lines: list[str]) -> tuple[list[int], list[list[float]]]:
    """(lines that could be furniture, what the furniture model sees of each and of the pairs it makes with its neighbours)."""
    n = len(lines)
    able = [k for k, x in enumerate(lines) if len(x) < 80 and 0 < len(s := x.strip()) < 60 and s[0] not in ">|" and not separator(s) and any(map(str.isalnum, s))]
    stripped = {k: lines[k].strip() for k in {x for k in able for x in (k - 1, k, k + 1) if 0 <= x < n}}
    run, stamp = {k: running(lines[k]) for k in stripped}, {k: is_stamp(s) for k, s in stripped.items()}
    title, num = {k: title_like(s) for k, s in stripped.items()}, {k: bool(_NUMBER.match(s)) for k, s in stripped.items()}
    able = [k for k in able if not run[k]]
    shapes = Counter(shape(stripped[k]) for k in able)
    # What stands before and after the run of short lines that a line belongs to: whether text goes on there, and the run's length.
    around: dict[int, list[float]] = {}
    group: list[int] = []
    for k in [*able, n + 1]:
        if group and k != group[-1] + 1:
            first, last = lines[group[0] - 1].strip() if group[0] else "", lines[group[-1] + 1].strip() if group[-1] + 1 < n else ""
            facts = [bool(first) and not _STOP.search(first), last[:1].islower(), bool(first) and running(first), bool(last) and running(last), min(6, len(group))]
            around |= dict.fromkeys(group, facts)
            group = []
        group.append(k)
    out = []
    for k in able:
        s = stripped[k]
        letters = sum(map(str.isalpha, s))
        before, after = stripped.get(k - 1, ""), stripped.get(k + 1, "")
        h = shape(s)
        out.append(
            [len(s), letters / len(s), sum(map(str.isupper, s)) / max(1, letters), sum(map(str.isdigit, s)) / len(s), stamp[k], title[k], num[k], bool(_CAPTION.match(s)), min(5, shapes[h]) if len(h) >= 4 else 0]
            + [float(d.get(x, False)) for d in (run, stamp, title, num) for x in (k - 1, k + 1)]
            + [bool(before) and not _STOP.search(before), after[:1].islower(), not before, not after, k < 3, "@" in s or "|" in s, s[-1] in ".,:?!"]
            + [lines[k][0] == "\f", k + 1 < n and lines[k + 1][:1] == "\f", s[0].islower(), *around[k]]
        )
    return able, out


def plant_pages(text: str, rng: Random) -> tuple[list[str], set[int]]:
    """(lines of a typed text with page breaks and small tables planted in it, the indices of the furniture)."""
    lines = text.split("\n")
    words = [w for w in re.findall(r"[^\W\d_]{3,}", text.lower())] or ["page"]
    some = lambda k: [rng.choice(words) for _ in range(k)]
    number, style = rng.randrange(1, 40), rng.randrange(6)
    roman = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
    code = "".join(rng.choice("ABCDEFGHIKLMNOPRST") for _ in range(rng.choice((2, 3))))
    k = rng.randrange(1, 5)
    head = rng.choice(
        [" ".join(w.capitalize() for w in some(k)), f"{' '.join(some(k)).upper()} NO. {rng.randrange(10, 9999)}", f"{some(1)[0].capitalize()} - {' '.join(some(k))}", f"{some(1)[0].capitalize()} of {some(1)[0].capitalize()}", f"{some(1)[0].capitalize()} {code[0]}-{rng.randrange(1, 99)}", " ".join(some(k)).upper()]
    )
    page = lambda: (str(number), f"- {number} -", f"[{number}]", f"{rng.choice(('p.', 'Page', 'Pg.'))} {number}", f"Page {number} of {number + 9}", roman[number % 10])[style]
    out: list[str] = []
    drop: set[int] = set()
    left, table = rng.randrange(6, 24), rng.random() < 0.4
    first, last = len(lines) > 30 and rng.random() < 0.7, rng.random() < 0.5  # a header over the text, a page number below it
    titled = rng.random() < 0.6  # a title that stands there once
    for k, x in enumerate([*lines, None]):
        if (k == 0 and first) or (x is None and last) or (k and left <= 0 and x is not None and x.strip()):
            block = [page()] if k and (x is None or rng.random() < 0.75) else []
            top = damage(head, rng) if rng.random() < 0.15 else head
            stamp = f"{code}{rng.choice(('-', ''))}{rng.choice((f'{rng.randrange(10**4, 10**7):07d}', f'{rng.randrange(1900, 2030)}-{rng.randrange(10**4):04d}'))}"
            block += {0: [top], 1: [f"{top}   {stamp}"], 2: [stamp], 3: [top, stamp]}[rng.randrange(4)] if rng.random() < 0.85 or not block else []
            if rng.random() < 0.4:
                at = rng.randrange(len(block))
                block[at] = "\f" + block[at]
            drop |= set(range(len(out), len(out) + len(block)))
            out += block
            left, number = rng.randrange(10, 30), number + 1
        if x is None:
            break
        if k == 0 and titled:
            out.append(" ".join(some(rng.choice((1, 1, 2, 3)))).upper() if rng.random() < 0.8 else " ".join(some(2)).title())
        if k and table and not x.strip() and rng.random() < 0.3:
            out += ["", f"{' '.join(some(2)).capitalize()}:"]
            out += [str(rng.randrange(1, 3000)) for _ in range(rng.randrange(2, 7))] if rng.random() < 0.5 else [f"{code}-{rng.randrange(1, 40)}   {rng.uniform(0, 99):.1f}   {rng.uniform(0, 9):.2f}" for _ in range(rng.randrange(2, 7))]
        out.append(x)
        left -= 1
    return out, drop


def train_lines(texts: list[str]) -> Boosted | None:
    """The furniture model, from page breaks planted in typed texts, whose own lines are no furniture."""
    rng = Random(5)
    x, y = [], []
    for t in texts:
        lines, drop = plant_pages(t, rng)
        able, f = line_features(lines)
        x += f
        y += [k in drop for k in able]
    return Boosted(rounds=60).fit(np.array(x, float), np.array(y)) if sum(y) >= 10 else None


def train_joins(lexicon: dict[str, int]) -> Boosted:
    """Whether a hyphen at a line end belongs to the word: torn lexicon words against compounds broken at their own hyphen."""
    rng = Random(11)
    x, y = [], []
    for w, n in sorted(lexicon.items())[:LEXICON]:
        if "-" in w:
            a, b = w.split("-", 1)
            x.append(join_features(a, b, lexicon))
            y.append(1)
        elif len(w) >= 5 and rng.random() < 0.5:
            k = rng.randrange(2, len(w) - 1)
            x.append(join_features(w[:k], w[k:], lexicon))
            y.append(0)
    if len(set(y)) < 2:
        return Boosted(base=-9.0, edges=[np.zeros(0)] * 6)
    return Boosted(rounds=30).fit(np.array(x), np.array(y))


def join_features(a: str, b: str, lexicon: dict[str, int]) -> list[float]:
    get = lambda w: np.log1p(lexicon.get(w, 0))
    return [get(f"{a}-{b}"), get(a + b), get(a), get(b), get(f"{a}-{b}") - get(a + b), min(len(a), len(b))]


_OUT = "doc {key}, line_no long, fix string, word string, clean boolean"


def torn_pairs(lexicon: dict[str, int]) -> set[tuple[str, str]]:
    """Pairs of lexicon words that side by side are another, much more frequent one torn by a space."""
    cuts = ((w[:i], w[i:], n) for w, n in lexicon.items() for i in range(1, len(w)))
    return {(a, b) for a, b, n in cuts if a in lexicon and b in lexicon and min(lexicon[a], lexicon[b]) * RARER < n}


def _repairer(lexicon: dict[str, int], more: bool, dirty: set[str], lines_model: Boosted | None, joins: Boosted, key_type: pa.DataType):
    """``more``: whether there are sound words beyond the lexicon, so that words torn by a space are to be looked up as well."""
    names, kinds = ["doc", "line_no", "fix", "word", "clean"], [key_type, pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def known(w: str) -> bool:
        return w in lexicon and w not in dirty

    memo: dict[tuple[str, str], float] = {}

    def keeps_hyphen(a: str, b: str) -> bool:
        if (a, b) not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[a, b] = float(joins.score(np.array([join_features(a, b, lexicon)]))[0])
        return memo[a, b] >= 0.5

    clean = frozenset(w for w in lexicon if w not in dirty)
    pairs = torn_pairs(lexicon)
    rarer = frozenset(w + p for a, b in pairs for w in (a if lexicon[a] <= lexicon[b] else b,) for p in ("", *".,?:;"))

    def torn_by(a: str, b: str) -> float:
        """How rare the rarer part is if the two are one word torn by a space, the longer word first; infinite if they are not."""
        n = lexicon.get(a + b)
        if n is None:
            return inf
        least = min(lexicon.get(a, 0), lexicon.get(b, 0))
        return least - len(a + b) / 1000 if least * RARER < n and known(a + b) and not (a.isdigit() or b.isdigit()) else inf

    glance: set[str] = set()

    def repair(text: str, lines: list[str], drop: set[int]) -> Iterator[tuple[int, str, str, bool]]:
        low_text = text.lower()
        low_lines, words = low_text.split("\n"), set(low_text.split())
        # Most lines are clean at a glance; those that hold one of these are looked at word by word.
        odd_words = {t for t in words - glance if not t.rstrip(".,?").isdigit() and any(map(str.isalnum, t))}
        few = rarer & words
        for k in drop:
            yield k + 1, "drop", "", True
        rows = text_lines(lines, drop)
        open_: list[tuple[int, str]] = []  # lines whose words need a closer look, with the line before each as its context
        for at, (i, line) in enumerate(rows):
            if line.rstrip()[-1:] in _HYPHENS and at + 1 < len(rows) and (m := _TORN.search(line)):
                after = _AFTER.match(rows[at + 1][1])
                if after and after[1][0].islower():
                    a, b = m[1].lower(), after[1].lower()
                    word = f"{a}-{b}" if keeps_hyphen(a, b) else a + b
                    pre = _BEFORE.search(line[: m.start(1)])
                    word = (pre[1].lower() if pre else "") + word
                    yield i + 1, "join", word, known(word)
            toks = low_lines[i].split()
            if not odd_words.isdisjoint(toks):
                rest = set(_TOKEN.findall(line.lower())) - clean
                if any(not t.isdigit() for t in rest):
                    open_.append((at, line))
                    continue
            if few and not few.isdisjoint(toks) and any(p in pairs for p in zip(toks, (t.rstrip(".,?:;") for t in toks[1:]))):
                open_.append((at, line))
        for at, line in open_:
            i = rows[at][0]
            before = rows[at - 1][1] if at else "."
            torn = before.rstrip()[-1:] in _HYPHENS and _TORN.search(before) is not None
            toks = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(line)]
            lows = [t[0].lower() for t in toks]
            odd = [j for j, w in enumerate(lows) if w not in clean or w in rarer]
            if not odd:
                continue
            end = _TORN.search(line) if line.rstrip()[-1:] in _HYPHENS else None
            cut = end.start(1) if end else len(line) + 1

            def usable(j: int) -> bool:
                """Whether a word is running text, and whole: in lower case or at the beginning of a sentence, no figure and not torn at a line end."""
                w, start, _ = toks[j]
                if (torn and j == 0) or start >= cut or lows[j].replace("-", "").isdigit():
                    return False
                if w[0].islower() or (w[0].isdigit() and any(c.islower() for c in w)):
                    return True
                gap = line[toks[j - 1][2] : start] if j else ""
                return w[1:].islower() and (_GAP.search(gap) is not None if j else _STOP.search(before) is not None)

            # How rare the rarer part is where two words side by side are one torn by a space, by the second word's place.
            beside = {k for j in odd for k in (j, j + 1) if 0 < k < len(toks) and toks[k][1] - toks[k - 1][2] == 1 and line[toks[k - 1][2]] == " "}
            rare = {k: r for k in beside if toks[k][0][0].islower() and (r := torn_by(lows[k - 1], lows[k])) < inf and (usable(k - 1) or usable(k))}
            taken = set()
            for k in sorted(rare):
                # Of two ways to put three parts together the one with the rarer part holds.
                if k - 1 not in taken and not rare.get(k + 1, inf) < rare[k]:
                    yield i + 1, "word", lows[k - 1] + lows[k], True
                    taken |= {k - 1, k}
            for j in odd:
                if j not in taken and lows[j] not in clean and usable(j):
                    yield i + 1, "word", lows[j], False
                    if more:
                        for k in (j, j + 1):
                            if k in beside and toks[k][0][0].islower() and lows[k - 1] + lows[k] not in lexicon:
                                yield i + 1, "torn", f"{lows[k - 1]} {lows[k]}", False

    def run(batches):
        glance.update(w + p for w in clean for p in ("", *".,?:;"))  # here, on the executor
        for b in batches:
            docs, whole = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts = [t.split("\n") for t in whole]
            drops, x, whose = [], [], []
            for j, lines in enumerate(texts):
                if not paged(whole[j]) and not hinted(whole[j], lines):  # no trace of a page
                    drops.append(set())
                elif lines_model is None:
                    drops.append({k for k in furniture_lines(lines) if not separator(lines[k].strip())})
                else:
                    able, f = line_features(lines)
                    drops.append(set())
                    x += f
                    whose += [(j, k) for k in able]
            if lines_model is not None and x:
                for (j, k), p in zip(whose, lines_model.score(np.array(x, float))):
                    if p >= 0.5:
                        drops[j].add(k)
            rows = [(doc, *r) for doc, text, lines, drop in zip(docs, whole, texts, drops) for r in repair(text, lines, drop)]
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return run


class Repairer:
    """The fitted models and the correction table of a corpus."""

    def __init__(self, documents: DataFrame, text: str = "text"):
        self.scratch = Scratch(documents.sparkSession, "ocr")
        texts = documents.select(F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
        counted = self.scratch.save(texts.mapInArrow(_counter, "w string, n long, typed long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("typed").alias("typed")))
        all_, typed = counted.agg(F.sum("n"), F.sum("typed")).first()
        self.share = (typed or 0) / (all_ or 1)
        # Fragments and misreadings, however frequent, are no words to read others as: they have hardly a share in typed texts. A corpus
        # of scans alone has no such texts, and every frequent word counts as sound.
        sound = (F.col("n") >= LEAST) & (F.col("typed") >= SOUND * self.share * F.col("n"))
        self.vocabulary = counted.withColumn("sound", sound)
        top = self.vocabulary.where("sound").orderBy(F.desc("n"), "w").limit(LEXICON + 1).collect()  # bounded by LEXICON
        self.more = len(top) > LEXICON
        self.lexicon = {r.w: r.n for r in top[:LEXICON]}
        self.ranker, self.joins = train_ranker(self.lexicon, self.share), train_joins(self.lexicon)
        self.corrections = self.scratch.save(corrections(self.vocabulary, self.ranker, self.share))
        lex = documents.sparkSession.createDataFrame([(w,) for w in self.lexicon] or [], "w string")
        self.dirty = {r.w for r in self.corrections.join(F.broadcast(lex), "w", "left_semi").select("w").collect()}  # within LEXICON
        # Typed texts among about twenty times as many chosen by hash.
        place = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
        some = texts.where((place < 20 * TRAIN_DOCUMENTS / max(1, texts.count())) & (F.length("text") < 20_000) & F.col("text").contains("\n"))
        sample = some.where(~F.col("text").rlike(_TRACE)).orderBy(F.xxhash64("text")).limit(TRAIN_DOCUMENTS)
        self.lines = train_lines(sorted(r.text for r in sample.collect()))  # bounded by TRAIN_DOCUMENTS

    def repairs(self, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_type

        d = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
        kind = d.schema["doc"].dataType
        found = self.scratch.save(d.mapInArrow(_repairer(self.lexicon, self.more, self.dirty, self.lines, self.joins, to_arrow_type(kind)), _OUT.format(key=kind.simpleString())))
        open_ = found.where("NOT clean AND fix <> 'torn'").join(self.corrections.withColumnRenamed("w", "word"), "word", "left")
        settled = open_.where("fix = 'join' OR c IS NOT NULL").select("doc", "line_no", "fix", F.coalesce("c", "word").alias("word"))
        out = found.where("clean").select("doc", "line_no", "fix", "word").unionByName(settled).distinct()
        if self.more:
            out = out.unionByName(self._torn(found)).distinct()
        return out.withColumnRenamed("doc", key)

    def _torn(self, found: DataFrame) -> DataFrame:
        """Words torn by a space that are not among those sent to the tasks, by their counts in the table."""
        v = self.vocabulary.where("sound").select("w", "n")
        t = found.where("fix = 'torn'").select("doc", "line_no", F.substring_index("word", " ", 1).alias("a"), F.substring_index("word", " ", -1).alias("b"))
        t = t.withColumn("w", F.concat("a", "b")).join(v, "w")
        for x in "ab":
            t = t.join(v.select(F.col("w").alias(x), F.col("n").alias(f"n{x}")), x, "left")
        rare = F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)))
        return t.where(rare * RARER < F.col("n")).select("doc", "line_no", F.lit("word").alias("fix"), F.col("w").alias("word"))


def repair_places(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, line_no, fix, word)``: every place of repair, once. Null and empty texts give none; a corpus too small to learn from gives
    joins and furniture only. Candidates of one score go to the word last in the alphabet. Extra columns are ignored."""
    return Repairer(documents, text).repairs(documents, key, text)
