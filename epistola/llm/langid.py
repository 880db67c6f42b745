"""Problem 9: document and passage languages by word-first backoff.

Each sentence is scored word by word. A known word counts by its log frequency in each language; an unseen one (a name, a
misread word) falls back to its character 5-grams, and while none of them is known to shorter ones, down to single
characters. Sentence scores add up; a passage holds the languages of its sentences, and a document those of its passages.

The model is fitted on a bounded sample: of each label at most about ``TRAIN_DOCUMENTS`` documents, chosen by a hash threshold (no
sort, no shuffle of texts). Labels are noisy, so the word counts are made twice, the second time only over sentences that the first
model finds to be in their label's language. Every document is then scored as a whole in one pass over the texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample, per label; least count of a known word; longest character n-gram of the backoff.
TRAIN_DOCUMENTS, LEAST_COUNT, NGRAM = 1500, 2, 5
#: A sentence of fewer words does not count. One whose best language leads by less (in nats) counts only where its passage has no other.
LEAST_WORDS, LEAD = 4, 3.0

WORD = re.compile(r"[^\W\d_]+")
_ENDS = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+(?=[\"'“‘«¿¡(\[]*[^\W_a-zß-öø-ÿ])")
_WHOLE = re.compile(r"^[\"'“‘«¿¡(\[]*[^\W_].*[.!?][\"'”’»)\]]*$", re.S)
_HEADER = re.compile(r"^\W*(?:from|to|cc|c|bcc|date|sent|sent by|author|subject|re|fw|fwd)\s*:", re.I)
_ASIDE = re.compile(r"\S+@\S+|[\"“„«][^\"“”„«».!?]{0,200}[\"”“»]")
_RUNNING = re.compile(r"(?<![^\W_])[a-zß-öø-ÿ][^\W\d_]+")
_HYPHEN = re.compile(r"([^\W\d_])[-\xad¬]\n(?=[a-zß-öø-ÿ])")
_QUOTE = re.compile(r"^[\s>|]+")


def passages(text: str) -> Iterator[tuple[int, list[str]]]:
    """(number, whole sentences) of each run of non-blank lines. Quote marks go, headers and lines that end with a colon stand apart."""
    number, lines = 0, []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            lines.append(line)
        elif lines:
            number += 1
            yield number, sentences(lines)
            lines = []


def sentences(lines: list[str]) -> list[str]:
    """Whole sentences: from a capital or figure to a full stop, with running words in between, so that no name, table row or page
    stamp passes for one. Words torn at a line end are joined; titles quoted inside a sentence are left out."""
    runs, run = [], []
    for line in lines:
        bare = _QUOTE.sub("", line).strip() if line[0] in " \t>|" else line.strip()
        if not bare or _HEADER.match(bare) or bare[-1] == ":":
            if run:
                runs.append(run)
            run = []
        else:
            run.append(bare)
    if run:
        runs.append(run)
    out = []
    for r in runs:
        text = _ASIDE.sub(" ", _HYPHEN.sub(r"\1", "\n".join(r)))
        out += [s for s in _ENDS.split(text) if _WHOLE.match(s) and len(_RUNNING.findall(s)) >= 2]
    return out


class Model:
    """Word and character n-gram log frequencies of each language."""

    def __init__(self, langs: list[str], counts: dict[str, Counter]):
        self.langs = langs
        n = len(langs)
        total = Counter()
        for c in counts.values():
            total.update(c)
        self.words = [w for w, c in total.items() if c >= LEAST_COUNT]
        size = np.array([max(1, sum(counts[x].values())) for x in langs], float)
        table = np.array([[counts[x].get(w, 0) for x in langs] for w in self.words], float).reshape(-1, n)
        self.word_rows = np.log((table + 0.1) / (size + 0.1 * (len(self.words) + 1)))
        grams: dict[str, np.ndarray] = {}
        for w, row in zip(self.words, table):
            weight = np.log1p(row)
            for g in self.pieces(w, range(1, NGRAM + 1)):
                if g in grams:
                    grams[g] = grams[g] + weight
                else:
                    grams[g] = weight
        sums = {k: sum((v for g, v in grams.items() if len(g) == k), np.zeros(n)) + 1.0 for k in range(1, NGRAM + 1)}
        self.grams = {g: np.log((v + 0.05) / sums[len(g)]) for g, v in grams.items()}
        self._cache: dict[str, int] = {}
        self._rows: np.ndarray | None = None

    @staticmethod
    def pieces(word: str, sizes) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + k] for k in sizes for i in range(len(w) - k + 1)]

    def backoff(self, word: str) -> np.ndarray:
        """The mean n-gram row of the longest size of which the word has a known n-gram; no preference if it has none."""
        for k in range(min(NGRAM, len(word) + 2), 0, -1):
            rows = [self.grams[g] for g in self.pieces(word, (k,)) if g in self.grams]
            if rows:
                return np.mean(rows, axis=0)
        return np.zeros(len(self.langs))

    def index(self, words: list[str]) -> np.ndarray:
        """Row numbers of words; rows of unseen words are made once and kept, up to a bounded number."""
        if self._rows is None or len(self._cache) > 400_000:
            self._cache = {w: i for i, w in enumerate(self.words)}
            self._rows = np.concatenate((self.word_rows, np.zeros((1024, len(self.langs)))))
        out = []
        for w in words:
            if (i := self._cache.get(w)) is None:
                i = self._cache[w] = len(self._cache)
                if i == len(self._rows):
                    self._rows = np.concatenate((self._rows, np.zeros_like(self._rows)))
                self._rows[i] = self.backoff(w)
            out.append(i)
        return np.array(out, dtype=np.int64)

    def score(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log scores per language, number of words) of sentences."""
        words = [WORD.findall(s.lower()) for s in found]
        n = np.array([len(w) for w in words], dtype=np.int64)
        out = np.zeros((len(found), len(self.langs)))
        flat = [x for w in words for x in w]
        if flat:
            ix = self.index(flat)  # before the rows are read: they may move
            some = np.flatnonzero(n)
            out[some] = np.add.reduceat(self._rows[ix], (np.cumsum(n) - n)[some], axis=0)
        return out, n

    def label(self, text: str | None) -> list[tuple[int, str, float, int]]:
        """(passage, language, confidence, sentences) for every passage with whole sentences and every language in it."""
        where, found = [], []
        for number, s in passages(text or ""):
            found += s
            where += [number] * len(s)
        if not found:
            return []
        scores, n = self.score(found)
        keep = n >= LEAST_WORDS
        if not keep.any():
            return []
        best = scores.argmax(axis=1)
        top = np.sort(scores, axis=1)
        lead = top[:, -1] - top[:, -2] if scores.shape[1] > 1 else np.full(len(found), math.inf)
        out: dict[tuple[int, int], list] = {}
        sure = {p for p, k, d in zip(where, keep, lead) if k and d >= LEAD}
        for i, p in enumerate(where):
            if keep[i] and (lead[i] >= LEAD or p not in sure):
                slot = out.setdefault((p, int(best[i])), [np.zeros(len(self.langs)), 0])
                slot[0] = slot[0] + scores[i]
                slot[1] += 1
        rows = []
        for (p, k), (s, c) in sorted(out.items()):
            rows.append((p, self.langs[k], float(1.0 / np.exp(np.clip(s - s[k], -700, 0)).sum()), c))
        return rows


def _counter(model: Model | None, langs: list[str]):
    """Partial word counts of labelled documents; with a model, only of sentences it finds to be in the label's language."""

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = [s for _, p in passages(text or "") for s in p]
                if model is not None and found:
                    k = langs.index(lang)
                    scores, _ = model.score(found)
                    found = [s for s, best in zip(found, scores.argmax(axis=1)) if best == k]
                for s in found:
                    counts.update((lang, w) for w in WORD.findall(s.lower()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    return run


def _collected(sample: DataFrame, model: Model | None, langs: list[str]) -> dict[str, Counter]:
    rows = sample.mapInArrow(_counter(model, langs), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out = {x: Counter() for x in langs}
    table = rows.where(F.col("n") >= LEAST_COUNT).toArrow()  # bounded by the training sample
    for lang, word, n in zip(*(table.column(k).to_pylist() for k in range(3))):
        out[lang][word] = n
    return out


def stated(lang: str = "lang"):
    """The language a label names: its first two letters in lower case, null if there is none or it is ``und``."""
    two = F.lower(F.substring(F.trim(F.col(lang)), 1, 2))
    return F.when(two.rlike("^[a-z]{2}$") & (F.lower(F.trim(F.col(lang))) != "und"), two)


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = TRAIN_DOCUMENTS) -> Model | None:
    """A model of every language that a label names at least twice; None if there is none."""
    labelled = documents.select(F.col(key).alias("doc"), F.col(text).alias("text"), stated(lang).alias("l")).where("l IS NOT NULL AND text IS NOT NULL")
    sizes = {r.l: r.n for r in labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # labels of two letters
    langs = sorted(x for x, n in sizes.items() if n >= 2)
    if not langs:
        return None
    share = F.create_map(*[F.lit(v) for x in langs for v in (x, min(1.0, per_label / sizes[x]))])
    place = F.shiftrightunsigned(F.xxhash64(F.col("doc").cast("string"), F.lit("fit")), 11) / F.lit(float(1 << 53))
    sample = labelled.where(F.col("l").isin(langs) & (place < share[F.col("l")])).select("l", "text")
    first = Model(langs, _collected(sample, None, langs))
    return Model(langs, _collected(sample, first, langs))


_OUT = "doc {key}, stated string, para_no long, lang string, confidence double, sentences int, doc_langs int, stated_found boolean"


def _labeller(model: Model, key_type: pa.DataType):
    def run(batches):
        for b in batches:
            rows = []
            for doc, label, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                found = model.label(text)
                langs = {r[1] for r in found}
                rows += [(doc, label, *r, len(langs), label in langs) for r in found]
            cols = list(zip(*rows)) if rows else [[] for _ in range(8)]
            kinds = [key_type, pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc", "stated", "para_no", "lang", "confidence", "sentences", "doc_langs", "stated_found"])

    return run


def label_passages(documents: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document, passage with whole sentences and language of these: ``doc, stated, para_no, lang, confidence, sentences,
    doc_langs`` (languages in the document) and ``stated_found`` (the label names one of them).

    Null and empty texts, and texts without a whole sentence, give no row. Without any usable label there is no model and the
    result is empty. Ties go to the language first in the alphabet. Extra columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    model = model or fit(documents, key, text, lang)
    d = documents.select(F.col(key).alias("doc"), stated(lang).alias("stated"), F.col(text).alias("text"))
    kind = d.schema["doc"].dataType
    schema = _OUT.format(key=kind.simpleString())
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    return d.where("text IS NOT NULL").mapInArrow(_labeller(model, to_arrow_type(kind)), schema)


def wrong_labels(documents: DataFrame, **names: str) -> DataFrame:
    """``(doc_id, para_no, lang)`` of documents without a label, with one in whose language no sentence is written, or in several languages."""
    p = label_passages(documents, **names)
    return p.where("stated IS NULL OR NOT stated_found OR doc_langs > 1").select(F.col("doc").alias("doc_id"), "para_no", "lang").distinct()


def label_documents(documents: DataFrame, **names: str) -> DataFrame:
    """One row per document with sentences: its main language (by sentences), that language's share, the confidence and all languages."""
    p = label_passages(documents, **names)
    per = p.groupBy("doc", "lang").agg(F.sum("sentences").alias("n"), F.avg("confidence").alias("confidence"))
    best = F.max(F.struct("n", "confidence", "lang"))
    out = per.groupBy("doc").agg(best.alias("b"), F.sum("n").alias("all"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
    return out.select(F.col("doc").alias("doc_id"), F.col("b.lang").alias("lang"), F.round(F.col("b.confidence"), 6).alias("confidence"), (F.col("b.n") / F.col("all")).alias("share"), "langs")
