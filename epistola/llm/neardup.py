"""Problem 6: near-duplicate documents by bands of least hashes and by fragments of the global n-gram order.

Similarity is the Jaccard measure of the sets of ``GRAM`` consecutive words. Documents with the same set form a *class*; the
join runs between classes, so copies cost nothing. Two classes of a sufficient similarity come up in one of two ways:

1. *Bands.* Every class is hashed many times over; the least values of its grams under ``ROWS`` hashes make a band. Two classes agree in a
   band with a chance of their similarity to the power of ``ROWS``, whatever else the corpus holds and wherever their texts differ. Texts of one trade
   share so many grams that chance meetings grow with the square of the corpus; so a class brings ``WORD`` bits of other least values to each of its
   bands, and a meeting whose bits agree too little ends where it is seen, in memory. The bands fall into ``GROUPS``, each with bits of its own, and are
   so many that a pair at the threshold gets through none of them with a chance of ``MISS`` at most (``plan``).
2. *Fragments.* A band that more than ``HOT`` classes and more than one in ``SHARE`` agree in, such as that of a stock paragraph, says little, and its pairs
   would grow with the square of the corpus. Its members are joined exactly instead, by vertical partitioning: their grams are put in one global order, the rarest first, and
   the order is cut into ``FRAGMENTS``; within each fragment the overlaps of the classes' leading parts are counted on their own and summed per pair.
   A pair at the threshold shares a gram within those leading parts, and its sum and the places of its hits bound what the rest can still add, so
   no pair is lost; and grams of a stock paragraph, which are the commonest, stand behind the leading parts of all that hold more than it.

What comes up is sifted by size, which is exact, and by all ``BITS`` bits of both classes, which loses a pair at the threshold with
a chance of ``MISS`` at most (binomial). The surviving pairs are verified exactly: the grams of both classes are compared over the whole texts.

No step collects a group; what a task sends of one band is bounded, and what it holds at once is one of ``BUCKETS`` equal parts of a pass's bands. The only quadratic part is the pairs within a class, and these are made only
where a caller asks for every pair of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from math import ceil, exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epistola.functions.wordhash import grams, hash_words, mix
from epistola.session import Scratch, maybe_broadcast

GRAM, ROWS = 3, 3
#: Greatest chance that the bands, or the sift, lose a pair at the threshold.
MISS = 1e-6
#: Groups of bands, and the bits that each has to itself.
GROUPS, WORD = 8, 128
#: Passes over the texts. Each sends the bands of its share of the groups, and what it shuffled is gone before the next, so that no more than that share of
#: the bands is on disk.
ROUNDS = 2
#: Bits of a class for the sift: those of all groups.
BITS = GROUPS * WORD
#: Least chance that a group's bits let a pair at the threshold through.
LET = 0.93
#: Most classes of a band whose pairs are all looked at, and the share of all classes (one in so many) from which more are hot; the members of hot bands
#: are joined by fragments of the gram order.
HOT, SHARE = 64, 64
#: Fragments of the gram order.
FRAGMENTS = 16
_BLOCK = 128


def _blocks(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for k in range(0, b.num_rows, _BLOCK):
            part = b.slice(k, _BLOCK)
            h, ptr = hash_words(part.column(1).to_pylist())
            for i, doc in enumerate(part.column(0).to_pylist()):
                yield doc, h[ptr[i] : ptr[i + 1]]


def _signature(g: np.ndarray) -> tuple[int, int]:
    """Two sums over a gram set, as the identity of the set."""
    return int(g.sum().view(np.int64)), int(mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64))


def _code(s1: np.ndarray) -> np.ndarray:
    """What stands for a class in its bands: the high half of its first sum. 0 stands for none."""
    return np.maximum((s1.view(np.uint64) >> np.uint64(32)).astype(np.uint32), 1)


def _at_least(many: int, chance: float, k: int) -> float:
    """The chance of k or more successes in so many trials."""
    if chance >= 1:
        return 1.0
    return sum(exp(lgamma(many + 1) - lgamma(i + 1) - lgamma(many - i + 1) + i * log(chance) + (many - i) * log(1 - chance)) for i in range(k, many + 1))


def plan(threshold: float) -> tuple[int, int]:
    """(bands, agreeing bits of a group that a meeting needs).

    A group's bits let a pair at the threshold through with a chance p, and each of its b bands brings it up with a chance t ** ``ROWS``. No hash serves two
    bands, two groups or a band and its bits, so the pair fails in a group with a chance of (1 - p) + p (1 - t ** ``ROWS``) ** b, and in all ``GROUPS`` with
    the power of that."""
    need = max(k for k in range(WORD + 1) if _at_least(WORD, (1 + threshold) / 2, k) >= LET)
    p = min(1.0, _at_least(WORD, (1 + threshold) / 2, need))
    return GROUPS * (1 if threshold >= 1 else ceil(log((MISS ** (1 / GROUPS) - (1 - p)) / p) / log(1 - threshold**ROWS))), need


def agreeing(threshold: float) -> int:
    """The bits in which a pair at the threshold agrees, but for a chance of ``MISS``."""
    if threshold >= 1:
        return BITS
    fewer, k = 0.0, 0
    differ = (1 - threshold) / 2
    while True:
        fewer += exp(lgamma(BITS + 1) - lgamma(k + 1) - lgamma(BITS - k + 1) + k * log(1 - differ) + (BITS - k) * log(differ))
        if fewer > MISS:
            return k
        k += 1


def _hashes(many: int) -> np.ndarray:
    return np.random.default_rng(20240501).integers(0, 2**31, many, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def least(g: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The least value of a gram set under each hash."""
    x, out = (g >> np.uint64(32)).astype(np.uint32), np.full(len(by), 2**32 - 1, np.uint32)
    for k in range(0, len(x), 64):
        np.minimum(out, (x[k : k + 64, None] * by).min(axis=0), out=out)
    return out


#: Equal parts of all bands, by the high bits of their keys, and the low bits of a key that are sent.
BUCKETS, LOW = 8192, 16


def keys(low: np.ndarray) -> np.ndarray:
    """A key for each band of each class, its bucket above its ``LOW`` bits; ``low``: the least values, a row for each class."""
    rows = low.reshape(len(low), -1, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(rows.shape[1], dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = mix(mix(key) + rows[:, :, k])
    return (key >> np.uint64(64 - LOW - BUCKETS.bit_length() + 1)).astype(np.uint32)


def bits(low: np.ndarray) -> np.ndarray:
    """One bit of each least value, as numbers: a row for each class."""
    return np.packbits((low * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint8), axis=1).view(np.uint64)


#: What one pass over the texts sends: under numbers of 0 or more the bands of one bucket, packed, under negative ones some texts with their class. The
#: passes after the first send only the texts of hot bands, without a size.
_SENT = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
_BAND = np.dtype([("low", "<u2"), ("code", "<u4"), ("word", "<u8", WORD // 64)])
_TEXT = np.dtype([("s1", "<i8"), ("doc", "<i8"), ("s2", "<i8"), ("n", "<i4"), ("hot", "<i4"), ("bits", "<u8", BITS // 64)])
#: Texts whose bands are put together before they are sent, texts of a row, and how many times ``HOT`` classes of one band are sent at most.
_CHUNK, _TOLD, _MOST = 8192, 64, 16


def _starts(k: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)


def _rows(numbers: np.ndarray, at: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
    """A row for each number with the part of ``packed`` from its place on."""
    ends = (np.append(at, len(packed)) * packed.itemsize).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(ends), pa.py_buffer(packed.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), column], schema=_SENT)


def _unpack(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(how many records each row holds, the records of all)."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.diff(ends) // kind.itemsize, np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data else np.zeros(0, kind)


def _sent(many: int, most: int, chunk: int, turn: int):
    def run(batches):
        by = _hashes(many * ROWS + BITS)
        band = np.arange(many)[np.arange(many) % GROUPS % ROUNDS == turn]
        groups = np.arange(turn, GROUPS, ROUNDS) if turn else np.arange(GROUPS)  # the first pass sends the bits of all
        place = np.searchsorted(groups, band % GROUPS)
        by = np.concatenate((by[: many * ROWS].reshape(many, ROWS)[band].ravel(), by[many * ROWS :].reshape(GROUPS, WORD)[groups].ravel()))
        context = TaskContext.get()
        number = context.partitionId() if context else 0
        seen: set[int] = set()  # classes whose bands this task has already written: copies are dropped before the shuffle
        members: list[tuple] = []
        sketch: list[np.ndarray] = []
        own: list[int] = []  # which members' bands are sent
        banded: list[np.ndarray] = []

        def flush():
            nonlocal number
            told = np.zeros(len(members), _TEXT)
            for name, values in zip(("s1", "doc", "s2", "n"), zip(*members)):
                told[name] = values
            words = np.concatenate(sketch)
            if not turn:
                told["bits"] = words
            if own:
                k = np.concatenate(banded).ravel()
                o = np.argsort(k, kind="stable")
                k = k[o]
                at = _starts(k)
                size = np.diff(np.append(at, len(k)))
                which, hot = np.array(own)[o // len(band)], np.repeat(size > most, size)
                # Of a band with too many classes only a mark is sent, and all of them are told to be in a hot one.
                told["hot"] = np.isin(told["s1"], told["s1"][which[hot]])
                first = np.zeros(len(k), bool)
                first[at] = True
                keep = ~hot | first
                out = np.zeros(int(keep.sum()), _BAND)
                out["low"] = k[keep] & np.uint32(2**LOW - 1)
                out["code"] = np.where(hot[keep], 0, _code(told["s1"])[which[keep]])
                out["word"] = words.reshape(len(words), len(groups), -1)[which[keep], place[o[keep] % len(band)]]
                bucket = k[keep] >> np.uint32(LOW)
                at = _starts(bucket)
                yield _rows(bucket[at], at, out)
            if turn:
                told = told[told["hot"] > 0]
                told["n"] = 0
            at = np.arange(0, len(told), _TOLD)
            yield _rows(-1 - (number * 1009 + np.arange(len(at))) % 2**30, at, told)
            number += len(at)
            for x in (members, sketch, own, banded):
                x.clear()

        def work(part: list[tuple]) -> None:
            low = np.stack([least(g, by) for _, g in part])
            new = []
            for i, (doc, g) in enumerate(part):
                s1, s2 = _signature(g)
                if s1 not in seen:
                    seen.add(s1)
                    own.append(len(members))
                    new.append(i)
                members.append((s1, doc, s2, len(g)))
            sketch.append(bits(low[:, len(band) * ROWS :]))
            if new:
                banded.append(keys(low[new, : len(band) * ROWS]))

        part: list[tuple] = []
        for doc, w in _blocks(batches):
            g = np.unique(grams(w, GRAM))
            if not len(g):
                continue
            part.append((doc, g))
            if len(part) >= min(_BLOCK, chunk):
                work(part)
                part = []
                if len(members) >= chunk:
                    yield from flush()
        if part:
            work(part)
        if members:
            yield from flush()

    return run


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc", pa.int64()), ("s2", pa.int64()), ("n", pa.int32()), ("bits", pa.binary())])


def _met(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), *[pa.nulls(len(a), f.type) for f in list(_MET)[2:]]], schema=_MET)


def _told(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts with their class, and the codes of those in a hot band as pairs with themselves."""
    hot = np.unique(_code(rows["s1"][rows["hot"] > 0]))
    yield _met(hot, hot)
    rows = rows[rows["n"] > 0]
    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows["bits"]))])
    s1, doc, s2, n = (pa.array(np.ascontiguousarray(rows[k])) for k in ("s1", "doc", "s2", "n"))
    cols = [s1, pa.nulls(len(rows), pa.int64()), doc, s2, n, packed.cast(pa.binary())]
    yield pa.RecordBatch.from_arrays(cols, schema=_MET)


#: Rows of whole buckets that are looked at together.
_AT_ONCE = 2**20


def _meetings(many: int, need: int, hot: int):
    """Rows sorted by bucket within a partition. Every band gives the pairs of its classes that enough bits of its group agree in, and a hot one its members,
    each paired with itself. ``a, b`` are codes."""

    def pairs(bucket: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        u = (bucket.astype(np.uint64) << np.uint64(LOW) | rows["low"]) << np.uint64(32) | rows["code"]
        o = np.argsort(u, kind="stable")
        u = u[o]
        at = _starts(u)  # copies of a class that other tasks sent
        u, word = u[at], rows["word"][o[at]]
        k, c = u >> np.uint64(32), (u & np.uint64(2**32 - 1)).astype(np.uint32)
        classes = len(u) * BUCKETS * ROUNDS // (many * len(_starts(bucket)))
        at = _starts(k)
        size = np.diff(np.append(at, len(k)))
        crowded = np.repeat((size > max(hot, classes // SHARE)) | (c[at] == 0), size)
        members = np.unique(c[crowded & (c > 0)])
        yield _met(members, members)
        k, c, word = k[~crowded], c[~crowded], word[~crowded]
        i, d = np.flatnonzero(k[1:] == k[:-1]), 1
        l, r, found = [], [], 0
        while len(i):  # every row against the d-th after it, as long as both are of one band
            ok = WORD - np.bitwise_count(word[i] ^ word[i + d]).sum(axis=1, dtype=np.int32) >= need
            l.append(c[i[ok]])
            r.append(c[i[ok] + d])
            found += len(l[-1])
            if found > _AT_ONCE:
                yield _met(np.concatenate(l), np.concatenate(r))
                l, r, found = [], [], 0
            d += 1
            i = i[i + d < len(k)]
            i = i[k[i + d] == k[i]]
        if l:
            l, r = np.concatenate(l).astype(np.uint64), np.concatenate(r).astype(np.uint64)
            once = np.unique(np.minimum(l, r) << np.uint64(32) | np.maximum(l, r))
            yield _met(once >> np.uint64(32), once & np.uint64(2**32 - 1))

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            number = b.column(0).to_numpy()
            apart = int(np.searchsorted(number, 0))
            if apart:
                yield from _told(_unpack(b.column(1).slice(0, apart), _TEXT)[1])
            if apart == len(number):
                continue
            size, rows = _unpack(b.column(1).slice(apart), _BAND)
            held.append((np.repeat(number[apart:], size), rows))
            if sum(len(x) for x, _ in held) >= _AT_ONCE:
                bucket, rows = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                yield from pairs(bucket[:cut], rows[:cut])
                held = [(bucket[cut:], rows[cut:])]
        if held:
            yield from pairs(*(np.concatenate(x) for x in zip(*held)))

    return run


def _gram_rows(batches):
    """``doc, n, g``: the grams of a text one by one, with their number."""
    for b in batches:
        docs, sizes, out = [], [], []
        for doc, w in _blocks([b]):
            g = np.unique(grams(w, GRAM))
            docs.append(np.full(len(g), doc))
            sizes.append(np.full(len(g), len(g), np.int32))
            out.append(g.view(np.int64))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        yield pa.RecordBatch.from_arrays([pa.array(cat(docs, np.int64)), pa.array(cat(sizes, np.int32)), pa.array(cat(out, np.int64))], names=["doc", "n", "g"])


def fragment_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """``da, db``: a superset of the pairs of texts (``doc, text``) of at least that similarity, by fragments of the global order of their grams.

    A set of n grams shares at least ceil(n t) of them with any set of similarity t, so at least one of its n - ceil(n t) + 1 rarest. With c hits in the
    leading parts, the last of them at places x and y, the rest can add min(n - x, m - y); both together must reach t / (1 + t) (n + m)."""
    rows = texts.mapInArrow(_gram_rows, "doc long, n int, g long")
    often = rows.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("doc").orderBy("df", "g")
    # Grams of one text alone join nothing, but stand first in the order and hold their places.
    placed = rows.join(often.where("df > 1"), "g").withColumn("at", F.row_number().over(order) + F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("doc")))
    placed = placed.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1)
    # The global order is by df and gram; its fragments are ranges of that order, cut within one df by the gram's own bits.
    fragment = F.pmod(F.floor(F.log2("df")) * 4 + F.shiftrightunsigned("g", 62), F.lit(FRAGMENTS)).cast("int")
    placed = placed.select("doc", "n", "g", "at", fragment.alias("fragment"))
    x, y = (placed.select("fragment", "g", F.col("doc").alias(f"d{k}"), F.col("n").alias(f"n{k}"), F.col("at").alias(f"at{k}")) for k in "ab")
    met = x.join(y, ["fragment", "g"]).where("da < db").where((F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")))
    partial = met.groupBy("fragment", "da", "db", "na", "nb").agg(F.count(F.lit(1)).alias("c"), F.max("ata").alias("ata"), F.max("atb").alias("atb"))
    summed = partial.groupBy("da", "db", "na", "nb").agg(F.sum("c").alias("c"), F.max("ata").alias("ata"), F.max("atb").alias("atb"))
    enough = F.col("c") + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9)
    return summed.where(enough).select("da", "db")


def _sift(least_bits: int):
    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(-1, BITS // 64) for k in (2, 3))
            ok = pa.array(BITS - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) >= least_bits)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["da", "db"])

    return run


#: Bytes kept of a gram's hash where two sets are compared.
WIDTH = 6


def _packed(g: np.ndarray) -> bytes:
    """A gram set as sorted hashes of ``WIDTH`` bytes each."""
    return np.unique(g & np.uint64(2 ** (8 * WIDTH) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(b, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def _overlap(batches):
    for b in batches:
        out = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            x, y = _unpacked(x), _unpacked(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])


@contextmanager
def _swept(spark: SparkSession):
    """What is saved within leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class NearDuplicates:
    """Classes of equal gram sets, and the verified links between them.

    ``classes``: ``doc, class`` (the least document of the class), ``n``. ``links``: ``a, b, similarity`` between classes.
    A null or empty text and one of fewer than ``GRAM`` words has no gram and belongs to no class. Repeated rows of one key
    with the same text fall into one row. Extra columns are ignored.
    """

    def __init__(self, documents: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text"):
        spark = documents.sparkSession
        self.scratch = Scratch(spark, "neardup")
        docs = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL")
        many, need = plan(threshold)
        with _swept(spark):
            rounds = []
            for turn in range(ROUNDS):
                sent = docs.mapInArrow(_sent(many, _MOST * HOT, _CHUNK, turn), "bucket int, packed binary").repartition("bucket").sortWithinPartitions("bucket")
                rounds.append(self.scratch.save(sent.mapInArrow(_meetings(many, need, HOT), "a long, b long, doc long, s2 long, n int, bits binary")))
            self.met = reduce(DataFrame.unionByName, rounds)
            members = rounds[0].where("doc IS NOT NULL").select("doc", F.col("a").alias("s1"), "s2", "n", "bits")
            # The two sums of a set together identify it; a set whose first sum collides with another's keeps its own class.
            rep = members.groupBy("s1", "s2").agg(F.min("doc").alias("class"), F.first("n").alias("n"), F.first("bits").alias("bits"))
            self.reps = self.scratch.save(rep)
            self.members = members
            self.links = self._links(docs, threshold)

    @property
    def classes(self) -> DataFrame:
        return self.members.join(self.reps.select("s1", "s2", "class"), ["s1", "s2"]).select("doc", "class", "n").distinct()

    def _links(self, docs: DataFrame, threshold: float) -> DataFrame:
        met = self.met.where("doc IS NULL").select("a", "b").distinct()
        hot = met.where("a = b").select("a")
        # Classes whose codes collide are both looked at.
        code = F.greatest(F.shiftrightunsigned("s1", 32), F.lit(1))
        da, db = (self.reps.select(code.alias(x), F.col("class").alias(f"d{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
        fits = (F.col("da") != F.col("db")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))
        near = met.where("a <> b").join(da, "a").join(db, "b").where(fits).select("da", "db", "bitsa", "bitsb")
        pairs = near.mapInArrow(_sift(agreeing(threshold)), "da long, db long")
        crowd = self.scratch.save(self.reps.withColumn("a", code).join(hot, "a", "left_semi").select(F.col("class").alias("doc")))
        pairs = pairs.unionByName(fragment_pairs(docs.join(maybe_broadcast(crowd), "doc", "left_semi").dropDuplicates(["doc"]), threshold))
        pairs = self.scratch.save(pairs.select(F.least("da", "db").alias("da"), F.greatest("da", "db").alias("db")).distinct())
        wanted = pairs.select(F.explode(F.array("da", "db")).alias("doc")).distinct()
        wanted = self.scratch.save(wanted)
        texts = docs.join(maybe_broadcast(wanted), "doc", "left_semi")
        sets = texts.select("doc", "text").mapInArrow(_doc_sets, "doc long, grams binary").dropDuplicates(["doc"])
        sets = self.scratch.save(sets)
        both = pairs.join(sets.select(F.col("doc").alias("da"), F.col("grams").alias("ga")), "da").join(sets.select(F.col("doc").alias("db"), F.col("grams").alias("gb")), "db")
        scored = both.select("da", "db", "ga", "gb").mapInArrow(_overlap, "a long, b long, similarity double")
        links = self.scratch.save(scored.where(F.col("similarity") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct())
        self.scratch.drop(crowd, pairs, wanted, sets)
        return links


def _doc_sets(batches):
    schema = pa.schema([("doc", pa.int64()), ("grams", pa.binary())])
    ids, sets = [], []
    for doc, w in _blocks(batches):
        ids.append(doc)
        sets.append(_packed(grams(w, GRAM)))
        if len(ids) >= 256:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], schema=schema)
            ids, sets = [], []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], schema=schema)


def similar_pairs(documents: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_a, doc_b)``: every pair of documents of at least that similarity, copies included, smaller key first."""
    near = NearDuplicates(documents, threshold, key, text)
    c = near.classes
    same = c.select("class", F.col("doc").alias("x")).join(c.select("class", F.col("doc").alias("y")), "class").where("x < y").select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"))
    a, b = (c.select(F.col("class").alias(k), F.col("doc").alias(f"d{k}")) for k in "ab")
    across = near.links.join(a, "a").join(b, "b").select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"))
    return same.unionByName(across)


def similar_groups(documents: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with a gram: ``doc, class, links`` (classes it is linked to) and ``group``, the least class of all
    that are linked to it directly or indirectly. Copies are not expanded into pairs."""
    from epistola.llm.components import connected_groups

    near = NearDuplicates(documents, threshold, key, text)
    turned = near.links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    name = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    groups = connected_groups(near.links.select(name("a").alias("src"), name("b").alias("dst"))).select(F.col("id").cast("long").alias("class"), F.col("group_id").cast("long").alias("group"))
    out = near.classes.join(turned, "class", "left").join(groups, "class", "left")
    return out.select("doc", "class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "class").alias("group"))
