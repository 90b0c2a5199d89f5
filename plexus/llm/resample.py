"""Operator 4: quality classification by importance resampling.

Two generative models over hashed n-grams -- the target (documents labelled good) and the raw corpus
-- give each document the log of its importance weight: ``ln(target share / raw share)`` of its
n-grams, summed over ``SIZE`` n-grams at the document's own mean (the whole sum would let length
decide; a smaller ``SIZE`` is a higher temperature).  Documents are drawn without replacement by the
Gumbel top-k trick: the k largest ``log weight + Gumbel noise`` are kept, the noise hashed from doc_id
and text so that reruns agree.  k is the expected number of documents like the target: the means of
labelled documents that the target model has not seen give, by Platt scaling, the chance of every
document of the corpus, and k is the sum.  The scaling sets how many are drawn, not their order.

Raw counts cover every document.  The target model and the scaling are fitted on at most ``SAMPLE``
labelled documents each (per class), chosen by hash.  Each task sums its own counts, so what is
shuffled is bounded by tasks times buckets; the two models are ``len(KINDS) << BITS`` numbers each.
The k-th largest key comes from a global range sort, not from a sort in one task.

Defined cases: null text and texts without n-grams are rejected (weight null); a word that repeats the
word before it counts as one special bigram with a bucket of its own; without labels of both classes
the chance is ``1 / (1 + exp(-mean))``; labels that are null or disagree for a doc_id are left out; of
rows that share a labelled doc_id the target takes all, the scaling the least mean; rows are judged each
by its own text, and rows equal in doc_id and text share their noise (``select`` keeps all of these if
it keeps one); a null doc_id is judged like others; an empty table gives an empty result; the query
ignores other columns and ``select`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.llm.common import keyed, ordered, saved, small, without
from plexus.llm.kernel import Block, blocks
from plexus.llm.ngrams import calibrate, grams, per_text

SAMPLE = 5000
BITS = 14
KINDS = (("w", 1), ("w", 2), ("c", 4))
#: n-grams whose log ratios make up a weight.
SIZE = 64


def _counted(b: Block):
    for k, kind in enumerate(KINDS):
        bucket, count = grams(b, kind, BITS)
        if kind == ("w", 2) and len(bucket):  # the same word again, whatever it is
            h = b.word_hashes()
            at = np.flatnonzero(b.wdoc[:-1] == b.wdoc[1:])
            bucket = np.maximum(bucket, 1)  # 0 is theirs alone
            bucket[h[at] == h[at + 1]] = 0
        yield k, bucket, count


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw = np.zeros(len(KINDS) << BITS, np.int64)
    target = np.zeros_like(raw)
    for batch in batches:
        good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, b in blocks(batch.column(0)):
            for k, bucket, count in _counted(b):
                part = slice(k << BITS, (k + 1) << BITS)
                raw[part] += np.bincount(bucket, minlength=1 << BITS)
                target[part] += np.bincount(bucket[np.repeat(good[lo:hi], count)], minlength=1 << BITS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def _weigh(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model.value
        for batch in batches:
            for lo, hi, b in blocks(batch.column(2)):
                z, n = np.zeros(b.n), np.zeros(b.n, np.int64)
                for k, bucket, count in _counted(b):
                    z += per_text(ratio[k << BITS : (k + 1) << BITS][bucket], count)
                    n += count
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n),
                        pa.array(np.round(z / np.maximum(n, 1), 9), mask=n == 0),
                    ],
                    names=["__id", "__h", "n_grams", "mean"],
                )

    return run


def clear_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, y, half)`` of the doc_ids with one quality label; ``half`` is hashed."""
    one = (
        labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
        .agg(F.min("quality").alias("y"), F.max("quality").alias("__other")).where("y = __other")
    )
    return one.select("doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(2)).alias("half"))


def _first(labels: DataFrame, where: str, sample: int) -> DataFrame:
    return labels.where(where).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)


def log_ratios(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """``ln(target share / raw share)`` of every bucket of every kind."""
    good = _first(clear_labels(labels), "y = 1 and half = 0", sample).select(F.col("doc_id").alias("__good"))
    marked = docs.join(F.broadcast(good), F.col("doc_id") == F.col("__good"), "left").select(
        F.col("text").cast("string").alias("text"), F.col("__good").isNotNull().alias("good")
    )
    sums = (
        marked.mapInArrow(_tally, "bucket long, raw long, target long").groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    )
    counts = np.zeros((2, len(KINDS) << BITS))
    for i, name in enumerate(("raw", "target")):
        counts[i][sums["bucket"].to_numpy()] = sums[name].to_numpy()
    if not counts[1].any():
        return np.zeros(len(KINDS) << BITS)
    out = []
    for raw, target in zip(*(c.reshape(len(KINDS), -1) for c in counts), strict=True):
        share = (raw + 1) / (raw.sum() + len(raw))
        # a bucket seen little in the sample falls back on the raw share
        prior = 50 * share
        out.append(np.log((target + prior) / (target.sum() + prior.sum())) - np.log(share))
    return np.concatenate(out)


def scaling(weighed: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, float]:
    """Slope and shift from mean log ratio to log odds, on labelled documents outside the target model."""
    clear = clear_labels(labels)
    seen = {r["y"]: r["count"] for r in clear.groupBy("y").count().collect()}
    if len(seen) < 2:
        return 1.0, 0.0
    chosen = _first(clear, "y = 1 and half = 1", sample).union(_first(clear, "y = 0", sample))
    means = weighed.where("mean is not null").join(F.broadcast(chosen), F.col("__id") == F.col("doc_id"))
    rows = means.groupBy("doc_id", "y").agg(F.min("mean").alias("mean")).toArrow()  # a row of each chosen document
    z, y = rows["mean"].to_numpy(), rows["y"].to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    order = np.lexsort((z, y))
    z, y = z[order], y[order]
    spread = max(float(z.std()), 1e-9)
    part = np.array([(y == 0).mean(), (y == 1).mean()])
    weight = np.array([seen[0], seen[1]]) / (seen[0] + seen[1]) / part
    slope, shift = calibrate(z / spread, y, weight[y])
    return max(slope, 0.0) / spread, shift


def drawn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(__id, __h, n_grams, log_weight, gumbel_key, kept)`` for every row of ``docs``."""
    texts = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    model = docs.sparkSession.sparkContext.broadcast(log_ratios(texts, labels, sample))
    weighed = saved(texts.select("__id", "__h", "text").mapInArrow(_weigh(model), "__id long, __h long, n_grams long, mean double"))
    slope, shift = scaling(weighed, labels, sample)
    k = weighed.agg(F.round(F.sum(1 / (1 + F.exp(-(F.col("mean") * slope + shift))))).alias("k")).first()["k"] or 0
    unit = (F.shiftrightunsigned(F.xxhash64("__id", "__h", F.lit(44)), 11).cast("double") + 0.5) / float(1 << 53)
    weighed = weighed.withColumn("log_weight", F.round(F.col("mean") * SIZE, 6))
    weighed = weighed.withColumn("gumbel_key", F.round(F.col("log_weight") - F.log(-F.log(unit)), 6))
    down = F.coalesce(-F.col("gumbel_key"), F.lit(float("inf")))
    ranked = ordered(weighed.withColumn("__down", down), ["__down", "__id", "__h"])
    kept = (F.col("__ix") < int(k)) & F.col("log_weight").isNotNull()
    return ranked.select("__id", "__h", "n_grams", "log_weight", "gumbel_key", kept.alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, n_grams, log_weight, gumbel_key, kept)`` for every row of ``docs``."""
    return drawn(docs, labels, sample).drop("__h").withColumnRenamed("__id", "doc_id")


def select(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that the resampling keeps."""
    verdict = drawn(docs, labels, sample).groupBy("__id", "__h").agg(F.max("kept").alias("kept"))
    out = saved(verdict.where("not kept").select("__id", "__h"))
    return without(keyed(docs), small(out)).select(*docs.columns)


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op4_importance_resampling": op4_importance_resampling}
ORACLES: dict = {}
