"""Operator 3: quality rules, with a hashed n-gram logistic regression as the last rule.

Base rules count words, code points in words, symbols, repeated lines and words in repeated 8-word
windows over each whole text.  A text that passes them is scored by a logistic regression over hashed
word and character n-grams, trained on labelled quality rows and calibrated by Platt scaling on
held-out rows; it is kept if its probability reaches ``THRESHOLD``.

The model is fitted on at most ``SAMPLE`` labelled rows of each class, chosen by hash; their features
are made on the executors and the fit runs on the driver, bounded by ``SAMPLE`` rows of at most
``len(KINDS) << BITS`` features.  All rows are counted and scored in Arrow batches.

Defined cases: null text counts as empty; a text with fewer than 20 words fails the base rules; with
labels of one class or none, or texts of one, the base rules alone decide (probability null); labels that are null or
disagree for a doc_id are left out; of rows that share a labelled doc_id the least text trains; rows that
share a doc_id, or have none, are judged each by its own text; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.llm.kernel import _SPACE, Block, blocks, by_group, windows
from plexus.llm.ngrams import calibrate, features, fit, rows_of, scores, sigmoid

SAMPLE = 1000
BITS = 16
KINDS = (("w", 1), ("w", 2), ("c", 3), ("c", 5))
THRESHOLD = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(b: Block) -> dict[str, np.ndarray]:
    """The counts of the base rules for every text of the block."""
    raw = b.raw
    lead = ~_SPACE[raw] & ((raw & 0xC0) != 0x80)
    doc_start = b.off[:-1][np.diff(b.off) > 0]
    breaks = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate([doc_start, breaks + 1]))
    start = start[start < len(raw)]
    stop = np.searchsorted(breaks, start)
    doc = np.searchsorted(b.off, start, "right") - 1
    end = np.minimum(np.concatenate([breaks, [len(raw)]])[stop], b.off[doc + 1])
    full = np.searchsorted(b.ws, end) > np.searchsorted(b.ws, start)
    start, end, doc = start[full], end[full], doc[full]
    h = b.hashes(start, end)
    order = np.lexsort((h, doc))
    again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    dup = np.bincount(doc[order][1:][again], minlength=b.n)

    s, at = windows(b.word_hashes(), b.wdoc, 8)
    order = by_group(s, b.wdoc[at])
    same = (s[order][1:] == s[order][:-1]) & (b.wdoc[at][order][1:] == b.wdoc[at][order][:-1])
    twice = np.zeros(len(s), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(b.ws) + 1, np.int64)
    cover[at[twice]] += 1
    cover[at[twice] + 8] -= 1
    covered = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": b.wn.astype(np.int64),
        "word_chars": b.counts(lead),
        "n_symbols": b.counts(_SYMBOL[raw]),
        "n_dup_lines": dup.astype(np.int64),
        "n_repeat_words": np.bincount(b.wdoc[covered], minlength=b.n).astype(np.int64),
    }


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, b in blocks(batch.column(1)):
            rows = features(b, KINDS, BITS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                ],
                names=["doc_id", "index", "value"],
            )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """``(weights, bias, a, b)`` of the calibrated model, or None without two classes."""
    clear = (
        labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
        .agg(F.min("quality").alias("y"), F.max("quality").alias("other")).where("y = other")
    )
    total = {r["y"]: r["count"] for r in clear.groupBy("y").count().collect()}
    if len(total) < 2:
        return None
    h = F.xxhash64("doc_id", F.lit(3))
    chosen = [clear.where(F.col("y") == y).orderBy(h, "doc_id").limit(sample).select("doc_id", "y") for y in (0, 1)]
    chosen = chosen[0].union(chosen[1])
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))  # one text of each, however often an id repeats
    found = (
        texts.select("doc_id", "text").mapInArrow(_sample_features, "doc_id long, index array<int>, value array<float>")
        .join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toArrow()
    )
    y = found["y"].to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2:  # no text of one class
        return None
    found = found.combine_chunks()
    rows = rows_of(found["index"], found["value"])
    held = np.array([(i * 2654435761 >> 7) % 5 == 0 for i in found["doc_id"].to_pylist()], bool)
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    dim = len(KINDS) << BITS
    w, bias = fit([r for r, out in zip(rows, held, strict=True) if not out], y[~held], dim)
    use = held if held.any() else ~held
    z = np.array([w[i] @ v + bias for (i, v), keep in zip(rows, use, strict=True) if keep])
    prior = total[1] / (total[0] + total[1])
    weight = np.where(y[use] == 1, prior / max((y[use] == 1).mean(), 1e-9), (1 - prior) / max((y[use] == 0).mean(), 1e-9))
    return w.astype(np.float32), bias, *calibrate(z, y[use], weight)


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b in blocks(batch.column(1)):
                base = base_counts(b)
                n = base["n_words"]
                failed = (n < 20) | (100 * base["n_repeat_words"] > 30 * n)
                kept, p = ~failed, pa.nulls(b.n, pa.float64())
                if model.value is not None:
                    w, bias, slope, shift = model.value
                    chance = sigmoid(slope * (scores(b, KINDS, BITS, w) + bias) + shift)
                    kept, p = kept & (chance >= THRESHOLD), pa.array(np.round(chance, 6))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *map(pa.array, base.values()), pa.array(failed), pa.array(kept), p],
                    names=["doc_id", *base, "base_failed", "kept", "probability"],
                )

    return run


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row of counts, verdicts and calibrated probability for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _judge(model),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, probability double",
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES: dict = {}
