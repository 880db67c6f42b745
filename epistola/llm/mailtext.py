"""Problem 2: the lines of a mail that its sender newly wrote.

A mail is exploded into its lines. One pass over each text marks what its own layout proves: the header block, quoted lines and
the lines that introduce them, forwarded messages, closing formulas with what stands below them, and page furniture. Three marks stay open and are
settled across the corpus, in SQL:

* ``maybe``, unmarked lines behind an introduction: the occurrences of the normalised line are ranked by date, and only its first sender keeps it;
* ``tail``, short closing lines without a formula: one that recurs at the end of several mails of its sender goes;
* ``end``, the last paragraphs of a mail without a closing: one of which at least half of the runs of ``RUN`` words recur below the closings of other
  mails is a disclaimer and goes. No wording is known beforehand.

The windows' partitions are one line's occurrences. Lines that stand in one mail only, nearly all, are dropped by a partial
aggregation before, so no text is shuffled and hot lines (a greeting) arrive as one row per sender and day.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epistola.functions.wordhash import grams, hash_words, mix
from epistola.llm.furniture import furniture_lines, running
from epistola.session import Scratch

MAIL = re.compile(r"\s*(?:from|author|sent by)\s*:", re.I)
#: In how many mails of one sender a closing line must recur to count as part of the signature.
RECURS = 2
#: Words of a run, and the share of a paragraph's runs that must recur below closings for it to be a disclaimer; paragraphs at the end that are asked.
RUN, DISCLAIMER, LAST = 4, 0.5, 2

_HEADER = re.compile(r"^\W{0,3}(?:from|author|sent by|to|cc|c|bcc|date|sent|subject|von|an|de|para|à|van|aan|datum|betreff|asunto|objet|assunto|onderwerp)\s*:", re.I)
_RULE = re.compile(r"^[\s>|]*-{2,}\s*[^\s-][^\n]{2,160}?\s*-{2,}\s*$")
_BAR = re.compile(r"^[\s>|]*[_=]{5,}\s*$")
_FORWARD = re.compile(r"^\W*begin forwarded message\W*$", re.I)
_SAID = re.compile(r"(?:\b(?:wrote|said|writes|schrieb|escribió|escribio|escreveu|schreef|a écrit|a ecrit)\b)[^\n]{0,120}:\s*$", re.I)
_ADDRESS = re.compile(r"\S+@\S+")
_DATE = re.compile(r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\b(?:\d{1,2}\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,4}\b", re.I)
_MARK = re.compile(r"^\s*[>|]")
_LIST = re.compile(r"^\s*(?:[<>]\s?\d+\s?[:.)]|\(?\d{1,2}[.)]\s|\(?[a-z][.)]\s|[-*•–+]\s+\S)")
_FIGURE = re.compile(r"^\s*>\s?\d")
_PS = re.compile(r"^\W*(?:p\.?\s?){1,2}s\b\.?", re.I)
_PHONE = re.compile(r"\b\d{3}-\d{4}\b")
_SIGNED = re.compile(r"^(?:--?|—|\*{4,}|~{3,}|_{2,4})\s*$")
_END = re.compile(r"[.!?][\"'”’)\]]*\s*$")
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def mail_day(text: str | None) -> int | None:
    """A day number from the usual ways to write a date; null if there is none. Only its order counts."""
    if not text:
        return None
    if m := re.search(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", text):
        y, mo, d = map(int, m.groups())
    elif m := re.search(r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", text):
        mo, d, y = map(int, m.groups())
    elif m := re.search(r"\b([A-Z][a-z]{2})[a-z]*\.? (\d{1,2}),? (\d{4})\b", text):
        mo, d, y = _MONTHS.get(m[1].lower(), 0), int(m[2]), int(m[3])
    elif m := re.search(r"\b(\d{1,2}) ([A-Z][a-z]{2})[a-z]*\.? (\d{4})\b", text):
        mo, d, y = _MONTHS.get(m[2].lower(), 0), int(m[1]), int(m[3])
    else:
        return None
    return y * 372 + mo * 31 + d


def _quoted(line: str, before: str, before_new: bool) -> bool:
    if not _MARK.match(line) or _LIST.match(line):
        return False
    # A figure that the line break left behind a "greater than" sign goes on with the sender's own sentence.
    return not (_FIGURE.match(line) and before_new and before.strip() and not _END.search(before))


def mark_lines(text: str) -> tuple[list[str], list[str]]:
    """(lines, marks) of a mail; a mark is ``new``, ``maybe``, ``tail``, ``end`` or ``old``, and ``""`` for blank lines."""
    return layout(text)[:2]


def layout(text: str) -> tuple[list[str], list[str], list[list[int]], list[list[int]]]:
    """(lines, marks, paragraphs marked ``end``, paragraphs below the closing)."""
    lines = text.split("\n")
    n = len(lines)
    marks = ["" if not x.strip() else "old" for x in lines]
    i = 0
    while i < n and not lines[i].strip():
        i += 1
    sender = set(re.findall(r"[^\W\d_]{3,}", lines[i].partition(":")[2].lower())) if i < n else set()
    while i < n and lines[i].strip():
        i += 1
    for k in furniture_lines(lines):
        marks[k] = "page"
    # Paragraphs of what is left, without the furniture: the lines of one paragraph, with whether a blank line stands before.
    paragraphs: list[list[int]] = []
    fresh = True
    for k in range(i, n):
        if marks[k] == "":
            fresh = True
        elif marks[k] != "page":
            if fresh:
                paragraphs.append([])
            paragraphs[-1].append(k)
            fresh = False
    signed, introduced, indented, prose = False, False, False, 0
    written: list[list[int]] = []
    below: list[list[int]] = []
    before, before_new = "", False
    j = 0
    while j < len(paragraphs):
        p = paragraphs[j]
        j += 1
        own: list[int] = []
        stop = False
        for at, k in enumerate(p):
            line = lines[k]
            follows = p[at + 1 :] + (paragraphs[j] if j < len(paragraphs) else [])
            if (_RULE.match(line) or _FORWARD.match(line)) and not _MARK.match(line):
                stop = True
            elif _BAR.match(line) and not _MARK.match(line) and follows and _HEADER.match(lines[follows[0]]):
                stop = True
            elif _HEADER.match(line) and at == 0 and len(p) > 1 and _HEADER.match(lines[p[1]]) and _ADDRESS.search(line):
                stop = True
            if stop:
                break
            two = line.rstrip() + " " + (lines[p[at + 1]].strip() if at + 1 < len(p) else "")
            if not _MARK.match(line) and (_SAID.search(line) or (_SAID.search(two) and not _END.search(line) and len(two) < 200 and (_DATE.search(two) or _ADDRESS.search(two)))):
                introduced, before_new = True, False
                if not _SAID.search(line):  # the introduction runs over two lines
                    before = "\0"
                continue
            if before == "\0":
                before = ""
                continue
            if _quoted(line, before, before_new):
                before, before_new = line, False
                introduced = indented = False if not introduced else introduced and indented
                continue
            if not before_new and _MARK.match(before) and at and not _END.search(before):
                before = "> " + line  # a quoted line that was broken again on its way
                continue
            if (introduced or indented) and re.match(r"^(?: {3,}|\t)", line):
                indented, before_new = True, False
                before = line
                continue
            own.append(k)
            before, before_new = line, True
        # A name with an address and a date right before marked lines introduce them.
        if own and len(own) <= 2 and j < len(paragraphs) and _ADDRESS.search(lines[own[0]]) and _MARK.match(lines[paragraphs[j][0]]) and all(_ADDRESS.search(lines[k]) or _DATE.search(lines[k]) for k in own):
            introduced, before_new, own = True, False, []
        if own:
            (below if signed else written).append(own)
            prose = _mark_own(lines, marks, own, sender, prose, signed, introduced and not indented)
            if prose < 0:
                signed, prose = True, -prose
            elif not stop:
                introduced = introduced and indented
        if stop:
            break
    # The last paragraphs of text, but for the first one, in a mail that has no closing.
    ends = [] if signed else [p for p in written[1:][-LAST:] if all(marks[k] == "new" for k in p) and not _PS.match(lines[p[0]])]
    for p in ends:
        for k in p:
            marks[k] = "end"
    below = [p for p in below if all(marks[k] == "old" for k in p)]
    return lines, ["old" if m == "page" else m for m in marks], ends, below


def _mark_own(lines: list[str], marks: list[str], own: list[int], sender: set[str], prose: int, signed: bool, behind: bool) -> int:
    """Marks one paragraph of unquoted lines. Returns the number of text paragraphs so far, negative where a signature has begun."""
    body = " ".join(lines[k].strip() for k in own)
    if _PS.match(body):
        for k in own:
            marks[k] = "new"
        return -max(prose, 1) if signed else prose
    if signed:
        return -max(prose, 1) if signed else prose
    first = lines[own[0]].strip()
    closing = None
    if _SIGNED.match(first):
        closing = 0
    else:
        for at, k in enumerate(own):
            line = lines[k].strip()
            rest = own[at + 1 :]
            if line.endswith(",") and len(line.split()) <= 4 and len(line) <= 32 and rest and len(rest) <= 7 and all(len(lines[r].strip()) <= 60 and not running(lines[r]) for r in rest) and (prose or at):
                closing = at
                break
            if _SIGNED.match(line) and at:
                closing = at
                break
    if closing is None and prose and len(own) <= 6 and not any(running(lines[k]) for k in own) and not any(_LIST.match(lines[k]) for k in own):
        named = bool(sender & set(re.findall(r"[^\W\d_]{3,}", body.lower())))
        if _PHONE.search(body) or body.count(" | ") >= 1 or (named and (_ADDRESS.search(body) or len(own) > 1)):
            closing = 0
    mark = "maybe" if behind else "new"
    for k in own[: len(own) if closing is None else closing]:
        marks[k] = mark
    if closing is not None:
        return -max(prose, 1)
    if prose and len(own) == 1 and not _END.search(body) and not _LIST.match(first) and len(body) <= 60:
        marks[own[0]] = "tail"
    return prose + 1


_SCHEMA = "doc {key}, line_no long, mark string, h long, day int, sender string, par long"


def _runs(paragraphs: list[str]) -> list[np.ndarray]:
    """The distinct runs of ``RUN`` words of each paragraph."""
    h, ptr = hash_words(paragraphs)
    return [np.unique(grams(h[ptr[i] : ptr[i + 1]], RUN)).view(np.int64) for i in range(len(paragraphs))]


def _marker(key_type: pa.DataType):
    names = ["doc", "line_no", "mark", "h", "day", "sender", "par"]
    kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, numbers, kept, days, senders, texts, pars = [], [], [], [], [], [], []
            asked: list[tuple] = []  # (document, first line, text) of paragraphs at an end
            known: list[tuple] = []  # (document, text) of what stands below a closing
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines, marks, ends, below = layout(text)
                first = {k: p[0] + 1 for p in ends for k in p}
                asked += [(doc, p[0] + 1, " ".join(lines[k] for k in p)) for p in ends]
                if below:
                    known.append((doc, "\n".join(lines[k] for p in below for k in p)))
                head = text.split("\n\n", 1)[0]
                day = mail_day("\n".join(x for x in head.split("\n") if re.match(r"\W{0,3}(?:date|sent)\s*:", x, re.I)))
                found = _ADDRESS.search(lines[0])
                sender = (found[0] if found else lines[0].partition(":")[2]).strip("<>\"' ").lower()
                for k, m in enumerate(marks):
                    if m and m != "old":
                        docs.append(doc)
                        numbers.append(k + 1)
                        kept.append(m)
                        days.append(day)
                        senders.append(sender)
                        texts.append(lines[k])
                        pars.append(first.get(k))
            h, ptr = hash_words(texts)
            size = np.diff(ptr)
            place = np.arange(len(h)) - np.repeat(ptr[:-1], size)
            sums = np.zeros(len(texts), np.uint64)
            np.add.at(sums, np.repeat(np.arange(len(texts)), size), mix(h + place.astype(np.uint64)))
            cols = [docs, numbers, kept, sums.view(np.int64).tolist(), days, senders, pars]
            for rows, mark in ((asked, "ask"), (known, "below")):
                for row, runs in zip(rows, _runs([r[-1] for r in rows]) if rows else ()):
                    n = len(runs)
                    for col, x in zip(cols, ([row[0]] * n, [None] * n, [mark] * n, runs.tolist(), [None] * n, [None] * n, [row[1] if mark == "ask" else None] * n)):
                        col.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return run


def new_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, line_no)`` of every line newly written by a mail's sender; lines count from 1.

    Texts that are null or empty or whose first line is no sender header are no mails and give no row. Mails without a date rank last. Of
    occurrences on one day the sender first in the alphabet is taken as author. Repeated rows of a key give their lines
    once. Extra columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    scratch = Scratch(documents.sparkSession, "mailtext")
    d = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.col("text").rlike(r"^(?i)\s*(from|author|sent by)\s*:"))
    kind = d.schema["doc"].dataType
    rows = scratch.save(d.mapInArrow(_marker(to_arrow_type(kind)), _SCHEMA.format(key=kind.simpleString())))
    lines = rows.where("line_no IS NOT NULL")
    # Paragraphs at an end whose runs of words recur below closings; each mail gives a run once.
    recurs = rows.where("mark = 'below'").groupBy("h").agg(F.countDistinct("doc").alias("n")).where(F.col("n") >= RECURS).select("h", F.lit(1).alias("seen"))
    asked = rows.where("mark = 'ask'").join(recurs, "h", "left").groupBy("doc", "par").agg(F.avg(F.coalesce("seen", F.lit(0))).alias("share"))
    disclaimers = asked.where(F.col("share") >= DISCLAIMER).select("doc", "par")
    written = lines.where("mark = 'end'").join(disclaimers, ["doc", "par"], "left_anti")
    open_ = lines.where("mark IN ('maybe', 'tail')").select("h").distinct()
    # One row per line, sender and day of those lines that an open mark asks about.
    seen = lines.join(open_, "h", "left_semi").groupBy("h", "sender", "day").agg(F.countDistinct("doc").alias("mails"), F.count_if(F.col("mark") == "tail").alias("tails"))
    by_date = Window.partitionBy("h").orderBy(F.col("day").asc_nulls_last(), "sender")
    by_sender = Window.partitionBy("h", "sender")
    ranked = seen.select("h", "sender", "day", F.first("sender").over(by_date).alias("author"), F.sum("tails").over(by_sender).alias("tails"))
    facts = ranked.groupBy("h", "sender").agg(F.first("author").alias("author"), F.max("tails").alias("tails"))
    settled = lines.where("mark IN ('maybe', 'tail')").join(facts, ["h", "sender"], "left")
    keep = settled.where(((F.col("mark") == "maybe") & (F.coalesce("author", "sender") == F.col("sender"))) | ((F.col("mark") == "tail") & (F.coalesce("tails", F.lit(0)) < RECURS)))
    return lines.where("mark = 'new'").select("doc", "line_no").unionByName(written.select("doc", "line_no")).unionByName(keep.select("doc", "line_no")).distinct().select(F.col("doc").alias(key), "line_no")


def new_text(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)``: each mail reduced to its new lines, in order."""
    rows = new_lines(documents, key, text).groupBy(key).agg(F.array_sort(F.collect_list("line_no")).alias("keep"))
    kept = rows.join(documents.select(key, text), key)
    at = F.split(F.col(text), "\n")
    return kept.select(key, F.array_join(F.transform("keep", lambda i: F.element_at(at, i.cast("int"))), "\n").alias("text"))
