"""Operator 12: SentencePiece encoding and decoding by vectorised merge rounds.

The driver reads the vocabulary of a BPE model; its tables (a few MB, bounded by the vocabulary) go to
the workers, which need neither the library nor the file.  A block of texts becomes one array of code
points with ``▁`` for blanks and before each text.  It is cut into words where no vocabulary piece can
reach across, and every different word is merged once while a task remembers it.  All their symbols lie
in flat numpy arrays: in each round every word finds the least rank among its neighbouring pairs and
merges all its pairs of that rank, leftmost first where they overlap; words without a pair leave, the
rest are compacted, until none is left.

Merging many pairs at once is exact where no later pair can come before them: a new pair has a worse
rank than the merge that made it.  Pieces for which the vocabulary does not guarantee that (``Tables.single``)
merge one at a time.  A word of over ``LONG`` symbols (a text without blanks whose letters all go
together) would need as many rounds as it has merges; it takes the same merges from a queue.

Characters outside the vocabulary become the byte pieces of their UTF-8 bytes.

Defined cases: null and empty texts hold the end id alone and decode to an empty text; blanks are kept,
as the model does not fold them; a text's ``▁`` is a blank to the model and decodes as one; very long
texts are one row; repeated rows and doc_ids stay as they are; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.llm.kernel import Block, blocks

LONG = 1000
#: A task forgets all words once it remembers more than this (about 60 B each).
REMEMBERED = 500_000
_BLANK = 0x2581
_NONE = np.int32(1 << 30)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Tables:
    """What encoding and decoding need of a model.  Symbols are piece ids, then characters that are no piece."""

    chars: np.ndarray  # code points of the vocabulary, ascending
    symbols: np.ndarray  # their symbols
    unknown: int  # the symbol of all other characters
    pairs: np.ndarray  # left symbol * (unknown + 1) + right symbol, ascending
    merged: np.ndarray  # the piece of each pair
    ranks: np.ndarray  # its place by score, best first; equal scores have equal ranks
    single: np.ndarray  # by piece: merge one at a time
    joints: np.ndarray  # neighbouring characters inside pieces, as left << 21 | right, ascending
    bytes_at: np.ndarray  # the piece of each byte
    end: int
    kind: np.ndarray  # by piece: 0 text, 1 byte, 2 control, 3 unknown
    text: list[bytes]  # by piece

    @property
    def base(self) -> int:
        return self.unknown + 1


def read_model(path: str) -> Tables:
    """Tables of the BPE model at ``path``; ValueError for models that work otherwise."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
    rules, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces
    odd = {p.type for p in model.pieces} - {kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN}
    if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or not plain or odd or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: not a BPE model with byte fallback, plain text and a blank before each text")

    pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
    letters = sorted({c for p in pieces for c in p})
    symbol = dict(pieces)
    for c in letters:
        symbol.setdefault(c, len(model.pieces) + len(symbol) - len(pieces))
    unknown = len(model.pieces) + len(symbol) - len(pieces)
    scores = sorted({model.pieces[i].score for i in pieces.values()}, reverse=True)
    place = {s: k for k, s in enumerate(scores)}
    rank = {p: place[model.pieces[i].score] for p, i in pieces.items()}
    pairs, single, joints = {}, np.zeros(len(model.pieces), bool), set()
    for p, i in pieces.items():
        joints.update(ord(a) << 21 | ord(b) for a, b in zip(p, p[1:], strict=False))
        for k in range(1, len(p)):
            left, right = p[:k], p[k:]
            if left in symbol and right in symbol:
                pairs[symbol[left] * (unknown + 1) + symbol[right]] = i
                for part in (left, right):
                    if part in rank and len(part) > 1 and rank[p] <= rank[part]:
                        single[pieces[part]] = True
    keys = np.array(sorted(pairs), np.int64)
    merged = np.array([pairs[k] for k in keys.tolist()], np.int32)
    by_piece = {i: rank[p] for p, i in pieces.items()}
    at = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
    code = {kinds.NORMAL: 0, kinds.BYTE: 1, kinds.CONTROL: 2, kinds.UNKNOWN: 3}
    surface = {kinds.CONTROL: lambda p: b"", kinds.UNKNOWN: lambda p: model.trainer_spec.unk_surface.encode(), kinds.BYTE: lambda p: bytes([int(p[3:5], 16)])}
    return Tables(
        np.array([ord(c) for c in letters], np.uint32), np.array([symbol[c] for c in letters], np.int32), unknown,
        keys, merged, np.array([by_piece[i] for i in merged.tolist()], np.int32), single, np.array(sorted(joints), np.int64),
        np.array([at[f"<0x{b:02X}>"] for b in range(256)], np.int32), model.trainer_spec.eos_id,
        np.array([code[p.type] for p in model.pieces], np.int8),
        [surface.get(p.type, lambda x: x.replace("▁", " ").encode())(p.piece) for p in model.pieces],
    )


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place in the table, whether it is there)`` of each key."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def _gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``flat[first : first + size]`` one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Merger:
    """Merges words of symbols by the ranks of a vocabulary."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.keys, self.ranks, self.merged = np.append(tables.pairs, -1), np.append(tables.ranks, _NONE), np.append(tables.merged, 0)
        # a hash table of places in ``pairs``: a key sits in its slot or in one of the next
        self.bits = max(4, int(np.ceil(np.log2(max(len(tables.pairs), 1)))) + 3)
        self.slots, slot, rest = np.full(1 << self.bits, -1, np.int32), self.slot(tables.pairs), np.arange(len(tables.pairs))
        while len(rest):
            free = rest[self.slots[slot[rest]] < 0]
            self.slots[slot[free]] = free  # one of those that meet stays
            rest = rest[self.slots[slot[rest]] != rest]
            slot[rest] = (slot[rest] + 1) & (1 << self.bits) - 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(rank, piece)`` of neighbours; rank ``_NONE`` where they do not go together."""
        keys = left.astype(np.int64) * self.t.base + right
        slot = self.slot(keys)
        at = self.slots[slot]
        rest = np.flatnonzero((self.keys[at] != keys) & (at >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (1 << self.bits) - 1
            at[rest] = self.slots[slot[rest]]
            rest = rest[(self.keys[at[rest]] != keys[rest]) & (at[rest] >= 0)]
        return self.ranks[at], self.merged[at]

    def merge(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(places, symbols)`` left of words that begin at ``first``: the old place of each symbol, ascending."""
        size = np.diff(np.append(first, len(sym)))
        place = np.arange(len(sym))
        long = np.repeat(size > LONG, size)
        out = [self.queue(sym[a : a + n], a) for a, n in zip(first[size > LONG].tolist(), size[size > LONG].tolist(), strict=True)]
        sym, place = sym[~long], place[~long]
        head = np.zeros(len(long) + 1, bool)
        head[first] = True
        head = head[:-1][~long]
        rank, piece = np.full(len(sym), _NONE), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(~head[1:]) if len(sym) else np.zeros(0, np.int64)
        rank[inner], piece[inner] = self.pair(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.flatnonzero(head)
            size = np.diff(np.append(start, len(sym)))
            least = np.minimum.reduceat(rank, start)
            done = np.repeat(least == _NONE, size)
            if done.any():
                out.append((place[done], sym[done]))
                sym, place, head, rank, piece = (x[~done] for x in (sym, place, head, rank, piece))
                size, least = size[least < _NONE], least[least < _NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            run = np.ones(len(hit), bool)  # overlapping pairs: every second one of a run, from its first
            run[1:] = hit[1:] != hit[:-1] + 1
            begin = np.flatnonzero(run)
            take = (np.arange(len(hit)) - np.repeat(begin, np.diff(np.append(begin, len(hit))))) % 2 == 0
            one = self.t.single[piece[hit]]
            if one.any():
                word = np.cumsum(head)[hit]
                new = np.ones(len(hit), bool)
                new[1:] = word[1:] != word[:-1]
                alone = np.maximum.reduceat(one, np.flatnonzero(new))[np.cumsum(new) - 1]  # the word merges one pair
                take = np.where(alone, new, take)
            hit = hit[take]
            sym[hit] = piece[hit]
            rank[hit] = rank[hit + 1]  # stays _NONE at the end of a word
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            sym, place, head, rank, piece = (x[keep] for x in (sym, place, head, rank, piece))
            ends = np.append(head[1:], True)
            again = np.zeros(len(sym) + 1, bool)
            again[at] = again[at - 1] = True
            rank[at[ends[at]]] = _NONE
            again = np.flatnonzero(again[:-1] & ~ends)
            rank[again], piece[again] = self.pair(sym[again], sym[again + 1])
        place, sym = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
        order = np.argsort(place)
        return place[order], sym[order]

    def queue(self, sym: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """The same merges in one long word, taken from a queue by (rank, place)."""
        rank, piece = self.pair(sym[:-1], sym[1:])
        n, s = len(sym), sym.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        near = {int(k): (r, p) for k, r, p in zip(self.t.pairs.tolist(), self.t.ranks.tolist(), self.t.merged.tolist(), strict=True)}
        heap = [(int(r), i, s[i], s[i + 1], int(p)) for i, (r, p) in enumerate(zip(rank.tolist(), piece.tolist(), strict=True)) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, p = heapq.heappop(heap)
            j = after[i]
            if s[i] != left or j >= n or s[j] != right:
                continue
            s[i], s[j], after[i] = p, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (x := near.get(s[a] * self.t.base + s[b])):
                    heapq.heappush(heap, (x[0], a, s[a], s[b], x[1]))
        left = np.array(s, np.int32)
        kept = np.flatnonzero(left >= 0)
        return kept + base, left[kept]


class _Symbols(Block):
    """Code points instead of bytes, for their range hashes."""

    def __init__(self, points: np.ndarray):
        self.buf, self._sum = points, None


class Encoder:
    """Encodes blocks of texts; words met before, about ``REMEMBERED`` of them, are not merged again."""

    def __init__(self, tables: Tables):
        self.t, self.merger = tables, Merger(tables)
        self.forget()
        self.symbol = np.full(0x110000, tables.unknown, np.int32)
        self.symbol[tables.chars] = tables.symbols
        joint = tables.joints
        self.cuts = not ((joint & 0x1FFFFF == _BLANK) & (joint >> 21 != _BLANK)).any()  # no piece goes on after a blank

    def forget(self) -> None:
        self.hash, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.first, self.size = np.array([self.t.end], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)  # place 0: the end id

    def places(self, points: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where ``first`` and ``size`` have the ids of each word ``points[first : last]``; new words are merged."""
        if not len(first):
            return np.zeros(0, np.int64)
        h, one, word = np.unique(_Symbols(points).hashes(first, last), return_index=True, return_inverse=True)
        _, known = _found(self.hash, h)
        new = one[~known]
        if len(new):
            size = (last - first)[new]
            ids, count = self.words(_gathered(points, first[new], size), np.cumsum(size) - size)
            at = np.searchsorted(self.hash, h[~known])
            self.place = np.insert(self.place, at, len(self.size) + np.arange(len(new)))
            self.hash = np.insert(self.hash, at, h[~known])
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
            self.size, self.flat = np.concatenate([self.size, count]), np.concatenate([self.flat, ids])
        return self.place[np.searchsorted(self.hash, h)][word]

    def words(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)`` of words that begin at ``first``."""
        sym = self.symbol[points]
        head = np.zeros(len(points), bool)
        head[first] = True
        inner = np.flatnonzero(~head)
        _, joint = _found(self.t.joints, points[inner - 1].astype(np.int64) << 21 | points[inner])
        parts = head.copy()
        parts[inner[~joint]] = True  # no piece holds these two neighbours
        place, sym = self.merger.merge(sym, np.flatnonzero(parts))
        odd = np.flatnonzero(sym >= len(self.t.text))  # characters without a piece
        size = np.ones(len(sym), np.int64)
        c = points[place[odd]].astype(np.int64)
        size[odd] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        at = np.cumsum(size) - size
        ids = np.repeat(sym, size)
        for n, mark in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            own = odd[size[odd] == n]
            c = points[place[own]].astype(np.int64)
            for k in range(n):
                value = c >> 6 * (n - 1 - k)
                ids[at[own] + k] = self.t.bytes_at[value | mark if k == 0 else value & 0x3F | 0x80]
        bound = np.append(first, len(points))
        total = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(place, bound)]
        return ids, np.diff(total)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)`` of the texts ``raw[off[i] : off[i + 1]]`` in UTF-8, each with the end id."""
        starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
        points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(points == 32, np.uint32(_BLANK), points)
        full = np.diff(starts) > 0
        points = np.insert(points, starts[:-1][full], np.uint32(_BLANK))
        bound = starts + np.concatenate([[0], np.cumsum(full)])
        head = np.zeros(len(points) + 1, bool)
        if self.cuts and len(points):
            blank = points == _BLANK
            head[1:-1] = blank[1:] & ~blank[:-1]
        head[bound[:-1][full]] = True
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(points))
        if len(self.hash) > REMEMBERED:
            self.forget()
        text = np.searchsorted(first, bound)
        order = np.insert(self.places(points, first, last), text[1:], 0)
        n = self.size[order]
        total = np.concatenate([[0], np.cumsum(n)])
        return _gathered(self.flat, self.first[order], n), np.diff(total[text + np.arange(len(text))])


codecs.register_error("plexus-each-byte", lambda e: ("�", e.start + 1))


class Decoder:
    def __init__(self, tables: Tables):
        self.t = tables
        self.size = np.array([len(x) for x in tables.text], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tables.text), np.uint8)
        self.blank = np.array([k == 0 and x[:1] == b" " for k, x in zip(tables.kind.tolist(), tables.text, strict=True)])

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The texts of the lists ``ids[off[i] : off[i + 1]]``: the blank before a text goes, bytes that are no UTF-8 become U+FFFD each."""
        data, at, kind = _gathered(self.flat, self.first[ids], self.size[ids]).tobytes(), np.concatenate([[0], np.cumsum(self.size[ids])]), self.t.kind[ids]
        total = at[off]
        apart = at[np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1]  # bytes on both sides of a control piece make no character
        seen = np.append(np.flatnonzero(kind != 2), len(ids))  # control pieces are not seen
        lead = seen[np.searchsorted(seen, off[:-1])]
        strip = (lead < off[1:]) & self.blank[ids[np.minimum(lead, max(len(ids) - 1, 0))]] if len(ids) else np.zeros(len(off) - 1, bool)
        out, after, before = [], np.searchsorted(apart, total[:-1], "right"), np.searchsorted(apart, total[1:], "left")
        for i, (a, b) in enumerate(zip((total[:-1] + strip).tolist(), total[1:].tolist(), strict=True)):
            bound = [a, *apart[after[i] : before[i]].tolist(), b]
            out.append("".join(data[x:y].decode("utf-8", "plexus-each-byte") for x, y in zip(bound, bound[1:], strict=False)))
        return out


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` for each row of ``docs(doc_id, text)``: the ids of the whole text and the end id."""
    tables = docs.sparkSession.sparkContext.broadcast(read_model(model_path or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in batches:
            for lo, hi, b in blocks(batch.column(1)):
                ids, counts = encoder.encode(b.raw, b.off)
                off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(off), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model_path: str | None = None) -> DataFrame:
    """``tokens(doc_id, ids)`` with ``text``, the text of the ids; null ids decode to null."""
    tables = tokens.sparkSession.sparkContext.broadcast(read_model(model_path or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tables.value)
        for batch in batches:
            lists, texts, lo = batch.column(1), [], 0
            missing = lists.is_null().to_numpy(zero_copy_only=False)
            off = np.concatenate([[0], np.cumsum(np.where(missing, 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))])
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            while lo < len(lists):  # about half a million ids at a time
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 19), "right")) - 1)
                texts += decoder.decode(ids[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string(), mask=missing)], names=["doc_id", "ids", "text"])

    ids = F.col("ids").cast("array<int>").alias("ids")
    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), ids).mapInArrow(run, "doc_id long, ids array<int>, text string")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op12_sentencepiece": op12_sentencepiece}
ORACLES: dict = {}
