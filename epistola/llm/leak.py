"""Problem 7: evaluation passages inside documents, by pigeonhole edit matching.

A leak is a stretch of at least ``SHARE`` of an item's words that stands in a document as one passage, with at most
``ERRORS`` of the stretch's words changed. A stretch of m words with a budget of k edits is cut into k + 1 pieces of at least m // (k + 1) words; an
edit spoils one of them at most, so one stands in the document as it is. Since a stretch may begin anywhere, the pieces of all
stretches together are the item's runs of L words, at every offset. An edit spoils L of a stretch's m - L + 1 runs at most, so a passage within the
budget holds at least m + 1 - L(k + 1) of them near one diagonal; L is the greatest length, up to m // (k + 1), for which that number is k + 1 or
more (or else m // (k + 1) itself, with a number of one or more). Both bounds are exact: no passage within the budget is lost.

1. The runs of all items form a table keyed by hash.
2. One pass over the corpus hashes every text; its runs meet the table, and the hits are counted per document, item and band of diagonals. A table of
   at most ``HELD`` pieces is sent to the tasks and looked up there. For a larger one the tasks emit the runs that a bitmap of the pieces knows,
   and an equality join and an aggregation do the same.
3. Pairs with enough hits are verified over the whole texts with Myers' bit-parallel edit distance over words.

Neither items nor documents are collected, and the number of items may grow as the corpus may.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistola.functions.wordhash import grams, hash_words
from epistola.session import Scratch, maybe_broadcast

SHARE, ERRORS = 0.4, 0.2
#: An item of fewer words has no piece.
LEAST = 3
#: Bits of the bitmap of piece hashes: a fixed size, whatever the number of items. More pieces only let more false hits through to the join.
BITMAP = 22
#: Most pieces that are sent to the tasks as a table (24 bytes each).
HELD = 1 << 20


def cut(n: int) -> tuple[int, int, int, int]:
    """(words of a stretch, edits allowed in it, words of a piece, pieces that stand near one diagonal at least) of an item of n words."""
    m = min(n, max(LEAST, ceil(SHARE * n - 1e-9)))
    k = int(ERRORS * m + 1e-9)
    most = m // (k + 1)
    size = next((x for x in range(most, 1, -1) if m + 1 - x * (k + 1) >= k + 1), most)
    return m, k, size, m + 1 - size * (k + 1)


def myers(pattern: list[int], text: list[int]) -> int:
    """Least edit distance between the pattern and any part of the text (Myers 1999, one machine word of any length)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask  # the text may begin anywhere: row 0 stays 0
        mh = (mh << 1) & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best = score
    return best


@dataclass
class Item:
    """One item's words and the exact bounds of its passages."""

    words: np.ndarray
    stretch: int
    budget: int
    size: int
    need: int

    @classmethod
    def of(cls, words: np.ndarray) -> Item | None:
        return cls(words, *cut(len(words))) if len(words) >= LEAST else None

    def pieces(self) -> np.ndarray:
        return grams(self.words, self.size)

    def leaks(self, doc: np.ndarray) -> bool:
        """Whether a passage of the item stands in a document's words."""
        own, g = self.pieces(), grams(doc, self.size)
        order = np.argsort(own, kind="stable")
        lo, hi = np.searchsorted(own[order], g, "left"), np.searchsorted(own[order], g, "right")
        pos = np.flatnonzero(hi > lo)
        times = hi[pos] - lo[pos]
        if times.sum() < self.need:
            return False
        p = np.repeat(pos, times)
        q = order[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo[pos], times)]
        # Hits near one diagonal: bins twice as wide as the band, once more shifted by half, hold every band whole.
        wide = 2 * (self.budget + 1)
        for shift in (0, 1):
            bin_ = (p - q + shift * (wide // 2)) // wide
            o = np.lexsort((q, bin_))
            bn, pp, qq = bin_[o], p[o], q[o]
            cuts = np.flatnonzero(np.diff(bn) != 0) + 1
            for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bn)]))):
                if b - a >= self.need and self._verified(doc, pp[a:b], qq[a:b]):
                    return True
        return False

    def _verified(self, doc: np.ndarray, p: np.ndarray, q: np.ndarray) -> bool:
        """p, q: hits near one diagonal, by q. Every stretch with enough distinct pieces among them is tried, those with the most first."""
        w, m, k = self.words, self.stretch, self.budget
        uq = np.unique(q)
        starts = np.arange(len(w) - m + 1)
        held = np.searchsorted(uq, starts + m - self.size, "right") - np.searchsorted(uq, starts, "left")
        if held.max() < self.need:
            return False
        # A word of the stretch that its surroundings lack costs an edit: no more than k may be lacking.
        near = doc[max(0, int((p - q).min()) - k) : len(w) + int((p - q).max()) + k]
        there = np.concatenate(([0], np.cumsum(np.isin(w, near))))
        able = (held >= self.need) & (there[m:] - there[: len(w) - m + 1] >= m - k)
        for s in starts[able][np.argsort(-held[able], kind="stable")]:
            own = (q >= s) & (q + self.size <= s + m)
            d = p[own] - q[own]
            lo, hi = max(0, s + int(d.min()) - k), s + m + int(d.max()) + k
            if myers(w[s : s + m].tolist(), doc[lo:hi].tolist()) <= k:
                return True
        return False


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, 128):
            part = b.slice(at, 128)
            h, ptr = hash_words(part.column(1).to_pylist())
            for i, key in enumerate(part.column(0).to_pylist()):
                yield key, h[ptr[i] : ptr[i + 1]]


_PIECES = "key long, at int, need int, wide int, size int"


def _cutter(id_type: pa.DataType):
    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for key, w in _split([b]):
                if item := Item.of(w):
                    g = item.pieces()
                    for col, x in zip(rows, ([key] * len(g), g.view(np.int64).tolist(), range(len(g)), [item.need] * len(g), [2 * (item.budget + 1)] * len(g), [item.size] * len(g))):
                        col.extend(x)
            kinds = [id_type, pa.int64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names=["item", *[x.split()[0] for x in _PIECES.split(", ")]])

    return run


def _holder(table: pa.Table, key_type: pa.DataType):
    """Pairs with enough hits in a band, by looking the runs of a block of texts up in the piece table at once."""
    ids = table.column("item").combine_chunks().dictionary_encode()
    key, at, need, wide, size = (table.column(x).to_numpy() for x in ("key", "at", "need", "wide", "size"))
    by_size = {}
    for x in np.unique(size):
        o = np.flatnonzero(size == x)
        o = o[np.argsort(key[o], kind="stable")]
        by_size[int(x)] = (key[o], ids.indices.to_numpy()[o].astype(np.int64), at[o], need[o], wide[o])

    def run(batches):
        for b in batches:
            docs, items = [], []
            for x in range(0, b.num_rows, 128):
                part = b.slice(x, 128)
                h, ptr = hash_words(part.column(1).to_pylist())
                for n, (k, item, at, need, wide) in by_size.items():
                    g = grams(h, n).view(np.int64)
                    lo, hi = np.searchsorted(k, g, "left"), np.searchsorted(k, g, "right")
                    pos = np.flatnonzero(hi > lo)
                    doc = np.searchsorted(ptr, pos, "right") - 1
                    own = pos + n <= ptr[doc + 1]  # a run lies within one text
                    pos, doc = pos[own], doc[own]
                    times = hi[pos] - lo[pos]
                    hit = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo[pos], times)
                    if not len(hit):
                        continue
                    doc, d, it, w, least = np.repeat(doc, times), np.repeat(pos, times), item[hit], wide[hit], need[hit]
                    d = d - np.repeat(ptr[:-1], np.diff(ptr))[d] - at[hit]
                    pair = doc * len(ids.dictionary) + it
                    _, which, many = np.unique(pair, return_inverse=True, return_counts=True)
                    some = many[which] >= least  # fewer hits in all
                    pair, d, w, least = pair[some], d[some], w[some], least[some]
                    enough = []
                    for shift in (0, 1):
                        band = (d + shift * (w // 2)) // w
                        o = np.lexsort((band, pair))
                        new = np.flatnonzero(np.concatenate(([True], (np.diff(pair[o]) != 0) | (np.diff(band[o]) != 0)))) if len(o) else np.zeros(0, int)
                        enough.append(pair[o][new[np.diff(np.append(new, len(o))) >= least[o][new]]])
                    found = np.unique(np.concatenate(enough))
                    docs.append(part.column(0).take(pa.array(found // len(ids.dictionary))))
                    items.append(ids.dictionary.take(pa.array(found % len(ids.dictionary))))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(docs) if docs else pa.array([], key_type), pa.concat_arrays(items) if items else pa.array([], ids.dictionary.type)], names=["doc", "item"])

    return run


def _emitter(bits: bytes, sizes: list[int], key_type: pa.DataType):
    """The runs of each text that the bitmap knows, with their places."""

    def run(batches):
        known = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
        for b in batches:
            docs, keys, places = [], [], []
            for doc, w in _split([b]):
                for size in sizes:
                    g = grams(w, size)
                    at = np.flatnonzero(known[(g >> np.uint64(64 - BITMAP)).astype(np.int64)])
                    if len(at):
                        docs += [doc] * len(at)
                        keys.append(g[at].view(np.int64))
                        places.append(at)
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(docs, key_type), pa.array(cat(keys), pa.int64()), pa.array(cat(places), pa.int32())], names=["doc", "key", "place"])

    return run


def _verify(batches):
    for b in batches:
        keep = []
        for at in range(0, b.num_rows, 128):
            part = b.slice(at, 128)
            d, dp = hash_words(part.column(2).to_pylist())
            t, tp = hash_words(part.column(3).to_pylist())
            keep += [bool((item := Item.of(t[tp[i] : tp[i + 1]])) and item.leaks(d[dp[i] : dp[i + 1]])) for i in range(part.num_rows)]
        ok = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["doc", "item"])


def _joined(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """``doc, item`` with enough hits in a band of diagonals, by an equality join."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc"].dataType
    # At most 2 ** BITMAP places, whatever the number of items, and a handful of piece lengths.
    places = pieces.select(F.shiftrightunsigned("key", 64 - BITMAP).alias("b")).distinct().toArrow().column(0).to_numpy()
    sizes = sorted(r.size for r in pieces.select("size").distinct().collect())
    bits = np.zeros(1 << BITMAP, bool)
    bits[places] = True
    known = docs.mapInArrow(_emitter(np.packbits(bits).tobytes(), sizes, to_arrow_type(kind)), f"doc {kind.simpleString()}, key long, place int")
    hits = known.join(pieces, "key").select("doc", "item", "need", "wide", (F.col("place") - F.col("at")).alias("d"))
    # Bands of diagonals, once more shifted by half, so that the hits of a passage fall into one of them whole.
    band = F.explode(F.array(F.floor(F.col("d") / F.col("wide")) * 2, F.floor((F.col("d") + F.expr("wide div 2")) / F.col("wide")) * 2 + 1)).alias("band")
    counted = hits.select("doc", "item", "need", band).groupBy("doc", "item", "need", "band").agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n >= need").select("doc", "item")


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id)``, each once: the items whose passage stands in a document.

    Null keys and null or empty texts match nothing, on either side; an item of fewer than ``LEAST`` words has no piece and never
    leaks; repeated rows count once, and of a repeated id each of its texts counts; extra columns are ignored. Empty tables give an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = documents.sparkSession
    scratch = Scratch(spark, "leak")
    docs = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    asked = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("asked")).where("item IS NOT NULL AND asked IS NOT NULL").distinct()
    doc_type, item_type = docs.schema["doc"].dataType, asked.schema["item"].dataType
    pieces = scratch.save(asked.mapInArrow(_cutter(to_arrow_type(item_type)), f"item {item_type.simpleString()}, {_PIECES}"))
    if pieces.limit(HELD + 1).count() <= HELD:
        found = docs.mapInArrow(_holder(pieces.toArrow(), to_arrow_type(doc_type)), f"doc {doc_type.simpleString()}, item {item_type.simpleString()}")
    else:
        found = _joined(docs, pieces)
    pairs = scratch.save(found.distinct())
    texts = docs.join(maybe_broadcast(pairs.select("doc").distinct()), "doc", "left_semi").distinct()
    both = pairs.join(texts, "doc").join(maybe_broadcast(asked), "item").select("doc", "item", "text", "asked")
    out = both.mapInArrow(_verify, f"doc {doc_type.simpleString()}, item {item_type.simpleString()}")
    return out.distinct().select(F.col("doc").alias(key), F.col("item").alias(item_key))
