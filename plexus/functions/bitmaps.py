"""Sets of documents as chunked bitmaps, for counting what sets share.

Documents are numbered in their own order, and a set is cut into chunks of 65 536 numbers.  A chunk of under
4 096 documents is a sorted list of 16-bit numbers, a fuller one a bitmap of 8 KB, so no row is larger, and the
chunks of a set in very many documents are rows of many tasks.  Two sets meet chunk by chunk: lists are intersected for a whole
batch at once, bitmaps are ANDed and their bits counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexus.functions.order import ordered
from plexus.sources.scratch import saved

#: Documents of a chunk as a power of two, bytes of a bitmap, and documents from which on it is one.
BITS, BYTES, DENSE = 16, 8192, 4096


def packed(low: np.ndarray) -> bytes:
    """The container of distinct, ascending numbers below 65 536."""
    if len(low) < DENSE:
        return low.astype("<u2").tobytes()
    marks = np.zeros(BYTES * 8, bool)
    marks[low] = True
    return np.packbits(marks, bitorder="little").tobytes()


def unpacked(container: bytes) -> np.ndarray:
    if len(container) < BYTES:
        return np.frombuffer(container, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little"))


def both(a: bytes, b: bytes) -> bytes:
    """The container of what two containers share; a bitmap meets a bitmap bit by bit, a list by look-up."""
    if len(a) < BYTES and len(b) < BYTES:
        return np.intersect1d(np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2"), assume_unique=True).tobytes()
    if len(a) == len(b) == BYTES:
        bits = np.frombuffer(a, np.uint8) & np.frombuffer(b, np.uint8)
        if int(np.bitwise_count(bits).sum()) >= DENSE:
            return bits.tobytes()
        return np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype("<u2").tobytes()
    few, many = (a, b) if len(a) < BYTES else (b, a)
    low = np.frombuffer(few, "<u2")
    return low[(np.frombuffer(many, np.uint8)[low >> 3] >> (low & 7)) & 1 == 1].tobytes()


def size(container: bytes) -> int:
    return len(container) // 2 if len(container) < BYTES else int(np.bitwise_count(np.frombuffer(container, np.uint8)).sum())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        flat, off = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        bits = [packed(np.sort(flat[a:b])) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(off)), pa.array(bits, pa.binary())], names=["concept", "chunk", "n", "bits"])


def bitmaps(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(maps, docs)`` of ``index(concept, doc)``: ``maps(concept, chunk, n, bits)`` and ``docs(doc, number)``, both written."""
    index = index.where("concept is not null and doc is not null")
    docs = saved(ordered(index.select("doc").distinct(), ["doc"]).select("doc", F.col("__ix").alias("number")))
    low = F.col("number").bitwiseAND((1 << BITS) - 1).cast("int")
    chunks = index.join(docs, "doc").groupBy("concept", F.shiftright("number", BITS).alias("chunk")).agg(F.collect_set(low).alias("low"))
    return saved(chunks.mapInArrow(_pack, f"concept {dict(index.dtypes)['concept']}, chunk long, n long, bits binary")), docs


def _meet(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(3), batch.column(4)
            wide = (np.array([len(x) for x in a.to_pylist()]) >= BYTES) | (np.array([len(x) for x in b.to_pylist()]) >= BYTES)
            n, firsts = np.zeros(len(a), np.int64), [np.zeros(0, np.int64)] * len(a)
            rows = np.flatnonzero(~wide)
            keys = []
            for column in (a, b):  # the row beside each number: all lists of the batch meet at once
                own = [np.frombuffer(column[int(i)].as_buffer(), "<u2") for i in rows]
                keys.append(np.repeat(rows, [len(x) for x in own]) << BITS | (np.concatenate(own) if own else np.zeros(0, np.int64)))
            found = np.intersect1d(*keys, assume_unique=True)
            at = found >> BITS
            n += np.bincount(at, minlength=len(a))
            cut = np.searchsorted(at, np.arange(len(a) + 1))
            for i in np.flatnonzero(n):
                firsts[i] = found[cut[i] : min(cut[i + 1], cut[i] + keep)] & ((1 << BITS) - 1)
            for i in np.flatnonzero(wide):
                shared = both(a[int(i)].as_py(), b[int(i)].as_py())
                n[i], firsts[i] = size(shared), unpacked(shared)[:keep]
            first = batch.column(2).to_numpy() << BITS
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(pa.array(hit)) for i in range(3)] + [pa.array(n[hit]), pa.array([(firsts[i] + first[i]).tolist() for i in hit], pa.list_(pa.int64()))],
                names=["subject", "object", "chunk", "n", "firsts"])

    return run


def shared(maps: DataFrame, pairs: DataFrame, keep: int) -> DataFrame:
    """``(subject, object, n, firsts)`` of distinct ``pairs`` that share documents: how many, and the numbers of the first ``keep``."""
    kind = dict(pairs.dtypes)["subject"]
    left = pairs.join(maps.select(F.col("concept").alias("subject"), "chunk", F.col("bits").alias("a")), "subject")
    met = left.join(maps.select(F.col("concept").alias("object"), "chunk", F.col("bits").alias("b")), ["object", "chunk"])
    met = met.select("subject", "object", "chunk", "a", "b").mapInArrow(_meet(keep), f"subject {kind}, object {kind}, chunk long, n long, firsts array<long>")
    before = Window.partitionBy("subject", "object").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    used = met.withColumn("used", F.coalesce(F.sum("n").over(before), F.lit(0)) < keep)  # at most ``keep`` chunks hold the first ones
    firsts = F.slice(F.array_sort(F.flatten(F.collect_list(F.when(F.col("used"), F.col("firsts"))))), 1, keep)
    return used.groupBy("subject", "object").agg(F.sum("n").alias("n"), firsts.alias("firsts"))


def _and_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(group_id, maps, n)`` from rows ``(group_id, chunk, bits)`` in the order of groups and chunks."""
    key, maps, held = None, 0, b""
    for batch in batches:
        out = []
        for group, chunk, bits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (group, chunk) != key:
                if key:
                    out.append((key[0], maps, size(held)))
                key, maps, held = (group, chunk), 1, bits
            else:
                maps, held = maps + 1, both(held, bits)
        yield _groups(out, batch.column(0).type)
    if key:
        yield _groups([(key[0], maps, size(held))], batch.column(0).type)


def _groups(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((kind, pa.int64(), pa.int64()))], names=["group_id", "maps", "n"])


def shared_by_all(maps: DataFrame, groups: DataFrame) -> DataFrame:
    """``(group_id, shared)``: the documents that all concepts of ``groups(group_id, concept)`` share; no row for none."""
    groups = groups.distinct()
    k = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("k"))
    dealt = groups.join(maps, "concept").select("group_id", "chunk", "bits").repartition("group_id", "chunk").sortWithinPartitions("group_id", "chunk")
    met = dealt.mapInArrow(_and_all, f"group_id {dict(groups.dtypes)['group_id']}, maps long, n long")
    return met.join(k, "group_id").where("maps = k and n > 0").groupBy("group_id").agg(F.sum("n").alias("shared"))
