"""Problem 8: mixing sources to target shares with hash-threshold histograms.

Every document gets a 64-bit hash of its key. The tokens of a source are summed by hash bucket; its budget then falls into one *boundary*
bucket: all documents below it are taken, all above are left, and only the boundary bucket is refined, by the next bits of
the hash, until it holds one hash value. Selection is the filter ``hash < threshold``: nothing is sorted, and the
selections for growing budgets are nested, so a larger mix always contains a smaller one.

What reaches the driver is one threshold per target source and level. The token counts are made once, by a public
tokenizer whose file is a parameter, and kept in the shared checkpoint folder.
"""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistola.session import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bits of the hash used per refinement level; 2 ** BITS buckets a source and level.
BITS, LEVELS = 12, (52, 40, 28, 16, 4, 0)

_ENCODERS: dict = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(re.sub(r"\W", "_", path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a text by a byte-level tokenizer in rank format; null counts 0. Special tokens' names are ordinary text."""

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        e = _encoder(tokenizer)
        return s.map(lambda t: len(e.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)


class Mix:
    """A mix of ``documents`` to the shares of ``targets`` (``source, weight, max_repeats``).

    A source's budget is ``weight * total``, total being the tokens of all documents of target sources unless given. A source
    is used as often as its budget asks for, ``max_repeats`` times at most: whole passes first, then one
    more copy of the documents below its hash threshold, taken as long as they fit the budget. A source that is too small gives all it has that
    often and falls short; its gap is reported and not filled by others.

    Documents with a null or untargeted source take no part; a null text counts 0 tokens; repeated rows of a key share its hash
    and are taken or left together; null or negative weights count 0, null ``max_repeats`` counts 1; a source named twice in ``targets``
    adds its weights and takes its greater cap. Extra columns are ignored.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text", source: str = "source"):
        self.scratch = Scratch(documents.sparkSession, "mix")
        wanted = targets.select("source", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap"))
        self.wanted = wanted.where("source IS NOT NULL").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("cap").alias("cap"))
        docs = documents.select(F.col(key).alias("doc"), F.col(source).alias("source"), token_count(F.col(text), tokenizer).alias("tokens")).where("source IS NOT NULL AND doc IS NOT NULL")
        # 63 bits, so that buckets order as the numbers do.
        docs = docs.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.col("doc").cast("string"), F.lit("mix")), 1))
        self.docs = self.scratch.save(docs)
        self.sizes = self.docs.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
        self.plan_rows = self._plan(total)

    def _plan(self, total: int | None) -> DataFrame:
        spark = self.docs.sparkSession
        sized = self.wanted.join(self.sizes, "source", "left").fillna(0, ["available", "documents"])
        if total is None:
            total = F.sum("available").over(Window.partitionBy())
        plan = sized.withColumn("target_tokens", F.round(F.col("weight") * total).cast("long"))
        passes = F.when(F.col("available") > 0, F.least(F.col("cap").cast("long"), F.expr("target_tokens div available"))).otherwise(F.lit(0).cast("long"))
        plan = plan.withColumn("passes", passes)
        rest = F.when((F.col("passes") < F.col("cap")) & (F.col("available") > 0), F.col("target_tokens") - F.col("passes") * F.col("available")).otherwise(F.lit(0).cast("long"))
        plan = self.scratch.save(plan.withColumn("rest", rest), files=1)
        bounds = self._thresholds(plan.where("rest > 0").select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("low")))
        return plan.join(F.broadcast(bounds), "source", "left").fillna(0, ["below"])

    def _thresholds(self, open_: DataFrame) -> DataFrame:
        """``source, below``: documents with ``h < below`` get one more copy. One row per source; each level narrows the interval
        ``[low, low + 2 ** shift)`` that holds the boundary."""
        spark = self.docs.sparkSession
        schema = "source string, left long, low long"
        rows = [tuple(r) for r in open_.collect()]  # one row per target source
        width = 63
        for shift in LEVELS:
            if not rows:
                break
            at = F.broadcast(spark.createDataFrame(rows, schema))
            inside = self.docs.join(at, "source").where((F.col("h") >= F.col("low")) & (F.shiftrightunsigned(F.col("h") - F.col("low"), width) == 0 if width < 63 else F.lit(True)))
            hist = inside.groupBy("source", "left", "low", F.shiftrightunsigned(F.col("h") - F.col("low"), shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
            run = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
            fits = hist.withColumn("upto", run).where("upto > left")
            edge = fits.groupBy("source", "left", "low").agg(F.min(F.struct("bucket", F.col("upto"), "tokens")).alias("e"))
            found = {r.source: (r.source, r.left - (r.e.upto - r.e.tokens), r.low + (r.e.bucket << shift)) for r in edge.collect()}  # one row per target source
            # A source whose remaining interval fits whole keeps the interval's end as its boundary.
            rows = [found.get(s, (s, left, low + (1 << min(width, 62)))) for s, left, low in rows]
            width = shift
        return spark.createDataFrame([(s, low) for s, _, low in rows] or [], "source string, below long")

    def copies(self) -> DataFrame:
        """``doc_id, source, tokens, copies`` of the documents in the mix."""
        plan = F.broadcast(self.plan_rows.select("source", "passes", "below"))
        n = (F.col("passes") + (F.col("h") < F.col("below")).cast("long")).cast("int")
        return self.docs.join(plan, "source").select(F.col("doc").alias("doc_id"), "source", "tokens", n.alias("copies")).where("copies > 0")

    def shares(self) -> DataFrame:
        """One row per target source: its target and what the mix really holds of it."""
        got = self.copies().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.count(F.lit(1)).alias("used_documents"), F.max("copies").alias("most_copies"))
        out = self.plan_rows.join(got, "source", "left").fillna(0, ["actual_tokens", "used_documents", "most_copies"])
        whole = F.sum("actual_tokens").over(Window.partitionBy())
        return out.select("source", F.col("weight").alias("target_share"), F.when(whole > 0, F.col("actual_tokens") / whole).otherwise(0.0).alias("actual_share"), "target_tokens", "actual_tokens", F.greatest(F.col("target_tokens") - F.col("actual_tokens"), F.lit(0)).alias("missing_tokens"), "available", "documents", "used_documents", "most_copies", F.col("cap").alias("max_repeats"))
