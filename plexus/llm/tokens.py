"""Operator 7: token ids as Parquet list columns, read back selectively.

Texts are encoded whole in Arrow batches by the tokenizers library.  Where the tokenizer drops white space
and never joins across it (``splits_words`` checks its settings and sample texts), a text's ids are the ids
of its words in order, and words are encoded once while a worker remembers them, about ``REMEMBERED`` at a
time; with other tokenizers each text is encoded by itself.  Documents are range-partitioned and sorted by id, one file per partition.  A
file holds ``doc_id, part, local_start, n_tokens, ids``: dictionary encoding packs the ids (delta
encoding on request), row groups and pages have set sizes, and the page index with the small columns
beside the list lets a reader fetch lengths and offsets without touching any ids.

Defined cases: null and blank texts hold the end id alone; rows that share a doc_id are written in
checksum order; a null doc_id sorts first; very long texts are one row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexus.llm.common import scratch
from plexus.llm.kernel import _LOWER, Block, blocks

END = 1
#: A worker forgets all words once it remembers more than this (about 50 B each).
REMEMBERED = 1_000_000
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?|%*&$#")] = True
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splits_words(tokenizer) -> bool:
    """Whether a text's ids are the ids of its words in order, and of a word's ending marks, as ``encode`` takes it.

    Known for lower-casing normalizers of NFC form without added spaces, and a model that ends words by ``</w>``;
    then checked on sample texts.
    """
    plan = json.loads(tokenizer.to_str())
    if (plan.get("model") or {}).get("end_of_word_suffix") != "</w>" or (plan.get("model") or {}).get("continuing_subword_prefix"):
        return False
    if '"add_prefix_space":true' in json.dumps(plan.get("pre_tokenizer"), separators=(",", ":")) or '"Prepend"' in json.dumps(plan.get("normalizer")):
        return False
    texts = ["The QUICK brown fox's 12 tails, 3.5 times!", "Über Äpfel, déjà-vu...  x\ty\nz", "a|b <c> d. e; f: g? h% i* j& k$ l#", "don't we're IT'S", "日本語 текст 123abc"]
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    for text in texts:
        parts = [p for w in text.split() for p in (w.rstrip(".,;:!?|%*&$#"), w[len(w.rstrip(".,;:!?|%*&$#")) :]) if p]
        if ids(text) != [i for p in parts for i in ids(p)] or ids(text.lower()) != ids(text):
            return False
    return True


class WordIds:
    """Ids of the word parts met so far, by 64-bit hash; place 0 is the end id, place 1 is empty."""

    def __init__(self, tokenizer):
        self.tokenizer, self.whole = tokenizer, not splits_words(tokenizer)
        self.hash, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.first, self.size = np.array([END], np.int32), np.zeros(2, np.int64), np.array([1, 0])
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a letter run
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def places(self, h: np.ndarray, b: Block, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of byte ranges of the block with hashes ``h``; new ones are encoded."""
        h, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        new = np.flatnonzero(self.hash[at] != h) if len(self.hash) else np.arange(len(h))
        if len(new):
            data, i, j = b.buf.tobytes(), start[one[new]].tolist(), end[one[new]].tolist()
            self.learn(h[new], [data[x:y].decode() for x, y in zip(i, j, strict=True)])
            at = np.searchsorted(self.hash, h)
        return self.place[at][inverse] if len(h) else np.zeros(0, np.int64)

    def learn(self, h: np.ndarray, parts: list[str]) -> None:
        """Add parts with new, sorted hashes.

        Letter runs are encoded many to a text and told apart by the ids that end one; others each by itself.
        """
        run = [x.isalpha() and (x.isascii() or normalize("NFC", x).lower().isalpha()) for x in parts]
        runs = [i for i, yes in enumerate(run) if yes]
        alone = [i for i, yes in enumerate(run) if not yes]
        groups = [runs[i : i + 500] for i in range(0, len(runs), 500)]
        size, flat, order = [], [], []
        joined = self.tokenizer.encode_batch_fast([" ".join([parts[i] for i in g]) for g in groups], add_special_tokens=False)
        for g, e in zip(groups, joined, strict=True):
            ids = np.array(e.ids, np.int32)
            ends = np.flatnonzero(self.last[np.minimum(ids, len(self.last) - 1)]) + 1
            if len(ends) == len(g):
                size.append(np.diff(ends, prepend=0))
                flat.append(ids)
                order += g
            else:
                alone += g
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast([parts[i] for i in alone], add_special_tokens=False)]
        size.append(np.fromiter(map(len, encoded), np.int64, len(encoded)))
        flat.append(np.fromiter(chain.from_iterable(encoded), np.int32, int(size[-1].sum())))
        size, order = np.concatenate(size), np.array(order + alone)
        at, place = np.searchsorted(self.hash, h), np.empty(len(h), np.int64)
        place[order] = len(self.size) + np.arange(len(h))
        self.hash = np.insert(self.hash, at, h)
        self.place = np.insert(self.place, at, place)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *flat])


def split_words(b: Block) -> np.ndarray:
    """Where the marks at the end of each word begin (its end if they cannot be split off); lower-cases ``b.buf``.

    The tokenizer always cuts between a letter or digit and a mark.  Words of ASCII and Latin-1 letters,
    digits and signs are lower-cased A-Z, as it does; others may compose with marks or hold special tokens
    and stay as they are, whole.
    """
    raw = b.raw
    latin = np.zeros(len(raw) + 1, bool)
    latin[:-1] = raw == 0xC3
    odd = (raw >= 0x80) & ~latin[:-1]
    odd[1:] &= ~latin[:-2]
    odd |= raw == ord("<")
    count = np.concatenate([[0], np.cumsum(odd)])
    plain = count[b.we] == count[b.ws]
    step = np.zeros(len(raw) + 1, np.int8)
    step[b.ws[plain]] += 1
    step[b.we[plain]] -= 1
    b.buf = np.where(np.cumsum(step[:-1], dtype=np.int8) > 0, _LOWER[raw], raw)
    if not len(b.ws):
        return b.we
    solid = np.maximum.accumulate(np.where(_MARK[raw], -1, np.arange(len(raw))))
    cut = solid[b.we - 1] + 1
    last = raw[np.maximum(cut - 1, 0)]
    latin_letter = (raw[np.maximum(cut - 2, 0)] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (cut - 2 >= b.ws)
    return np.where(plain & (cut > b.ws) & (_ALNUM[last] | latin_letter), cut, b.we)


def encode(b: Block, known: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, counts)`` of all texts of the block, each with the end id."""
    if known.whole:
        data = b.raw.tobytes()
        texts = [data[x:y].decode("utf-8", "surrogatepass") for x, y in zip(b.off[:-1].tolist(), b.off[1:].tolist(), strict=True)]
        ids = [np.array([*e.ids, END], np.int32) for e in known.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
    cut = split_words(b)
    marked = cut < b.we
    core = known.places(b.hashes(b.ws, cut), b, b.ws, cut)
    marks = np.ones(len(b.ws), np.int64)
    marks[marked] = known.places(b.hashes(cut[marked], b.we[marked]), b, cut[marked], b.we[marked])
    counts = 2 * b.wn + 1
    at = np.zeros(int(counts.sum()), np.int64)
    spot = 2 * np.arange(len(b.ws)) + b.wdoc  # an end id follows the words of each text
    at[spot], at[spot + 1] = core, marks
    size = known.size[at]
    ends = np.cumsum(size)
    ids = known.flat[np.repeat(known.first[at] - (ends - size), size) + np.arange(int(ends[-1]))]
    return ids, np.add.reduceat(size, np.cumsum(counts) - counts)


#: Kept between the tasks of a Python worker.
_workers: dict[str, WordIds] = {}


def _encoded(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        known = _workers.pop(tokenizer_path, None) or WordIds(Tokenizer.from_file(tokenizer_path))
        start, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi, b in blocks(batch.column(1)):
                if len(known.hash) > REMEMBERED:
                    known = WordIds(known.tokenizer)
                ids, counts = encode(b, known)
                ends = np.cumsum(counts)
                off = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.full(hi - lo, part, np.int32)),
                        pa.array(start + ends - counts),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(off), pa.array(ids)),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])
        _workers[tokenizer_path] = known

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str | None = None, encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 1000,
) -> None:
    """Write ``docs(doc_id, text)`` as token files under ``path`` in ascending doc_id order."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = ["doc_id", F.crc32(F.coalesce(text, F.lit("")).cast("binary"))]
    rows = rows.repartitionByRange(F.col("doc_id"), order[1]).sortWithinPartitions(*order)  # a doc_id may repeat over files
    done = rows.mapInArrow(
        _encoded(tokenizer_path or default_tokenizer()),
        "doc_id long, part int, local_start long, n_tokens long, ids array<int>",
    )
    writer = done.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes)
    writer = writer.option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
    if encoding == "dictionary":
        writer = writer.option("parquet.enable.dictionary", "true")
    elif encoding == "delta":  # version 2 pages use delta binary packing where there is no dictionary
        writer = writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0")
    else:
        raise ValueError(f"encoding is dictionary or delta, not {encoding!r}")
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """``(doc_id, start, n_tokens, *columns)`` of token files; only those columns are read.

    ``start`` adds to the offset in the file the token totals of the files before (one row per file).
    """
    files = spark.read.schema("doc_id long, part int, local_start long, n_tokens long, ids array<int>").parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    offsets = totals.select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return files.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("__before") + F.col("local_start")).alias("start"), "n_tokens", *columns
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        data = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        off = lists.offsets.to_numpy()
        crc = [zlib.crc32(data[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


QUERIES = {"op7_token_files": op7_token_files}
ORACLES: dict = {}
