"""Nearest vectors by cosine over an index of cells, without loss.

Centres are fitted on a bounded sample; every vector belongs to the cell of its nearest centre, and a cell knows the
widest angle of its vectors.  By the triangle inequality of angles no vector of a cell is nearer to
a query than the query's angle to the centre less that width.  A query first meets the nearest
cells that hold enough vectors; the last of its best ones so far then rules out all cells that cannot do better.  Scores
are exact, so the recall is 1; cells only save work, much where vectors form clusters and little where they are spread
evenly in many dimensions.

Cells are dealt in blocks of about ``BLOCK`` vectors; a task holds one block and runs the queries past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexus.sources.scratch import saved

#: Vectors that the centres are fitted on, the most centres, and vectors of a block.
SAMPLE, CELLS, BLOCK = 5000, 256, 4096


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def centres(sample: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """``k`` unit vectors by spherical k-means from evenly picked starts."""
    x = _units(sample)
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


class Index:
    """``rows(cell, part, id, vector)``, a written table, with centres, the width and the number of rows of each cell."""

    def __init__(self, vectors: DataFrame, sample: int = SAMPLE, cells: int = CELLS, block: int = BLOCK):
        """``vectors(id, vector)``: of one length; null, empty and zero vectors have no cosine and are left out."""
        usable = _usable(vectors)
        some = usable.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()  # a bounded sample
        dims = {len(r["vector"]) for r in some}
        if len(dims) > 1:
            raise ValueError("vectors differ in length")
        self.kind = dict(vectors.dtypes)["id"]
        self.centres = centres(np.array([r["vector"] for r in some], float), max(1, min(cells, int(len(some) ** 0.5)))) if some else np.zeros((1, 1))
        c = usable.sparkSession.sparkContext.broadcast(self.centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                angle = _angles(_units(_matrix(batch.column(1))), c.value) if len(batch) else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(angle.argmin(1).astype(np.int32)), pa.array(angle.min(1) if len(angle) else np.zeros(0))], names=["id", "vector", "cell", "angle"])

        rows = saved(usable.mapInArrow(assign, f"id {self.kind}, vector array<double>, cell int, angle double"))
        known = rows.groupBy("cell").agg(F.max("angle").alias("width"), F.count(F.lit(1)).alias("n")).collect()  # one row per cell
        self.width, self.n = np.full(len(self.centres), -1.0), np.zeros(len(self.centres), np.int64)
        for r in known:
            self.width[r["cell"]], self.n[r["cell"]] = r["width"], r["n"]
        self.parts = np.maximum(-(-self.n // block), 1)
        parts = F.get(F.array(*[F.lit(int(p)) for p in self.parts]), F.col("cell"))
        self.rows = rows.select("cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "vector")

    def _cells(self, queries: DataFrame, first: bool, most: int, least: float, score) -> DataFrame:
        """``(query_id, query, cell, part)``: the first cells of ``queries(query_id, query)``, or with ``bar`` those that may beat it."""
        c, width, n, parts = self.centres, self.width, self.n, self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches if n.any() else ():
                out: list[list] = [[], [], []]
                angle = _angles(_units(_matrix(batch.column(1))), c) if len(batch) else np.zeros((0, len(c)))
                near = np.maximum(angle - width, 0.0)
                best = score(np.cos(np.maximum(near - 1e-9, 0.0)))
                bars = batch.column(2).to_numpy(zero_copy_only=False) if not first else None
                for i in range(len(batch)):
                    order = np.argsort(near[i], kind="stable")
                    order = order[n[order] > 0]
                    enough = int(np.searchsorted(np.cumsum(n[order]), most + 1)) + 1  # one more: the query itself may be among them
                    mine = order[:enough] if first else order[enough:][best[i][order[enough:]] >= bars[i] - 1e-6]
                    mine = mine[best[i][mine] >= least - 1e-6]
                    for cell in mine.tolist():
                        for part in range(int(parts[cell])):
                            for column, v in zip(out, (i, cell, part), strict=True):
                                column.append(v)
                at = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["query_id", "query", "cell", "part"])

        kind = dict(queries.dtypes)["query_id"]
        return queries.mapInArrow(run, f"query_id {kind}, query array<double>, cell int, part int")

    def _scan(self, probes: DataFrame, most: int, least: float, score) -> DataFrame:
        """``(query_id, id, score)``: the best ``most`` of each block for each query that meets it."""
        none = F.lit(None).cast(self.kind)
        both = self.rows.select("cell", "part", F.lit(0).alias("asks"), "id", "vector").join(probes.select("cell", "part").distinct(), ["cell", "part"], "left_semi").select(
            "cell", "part", "asks", "id", none.alias("query_id"), "vector")
        both = both.union(probes.select("cell", "part", F.lit(1), none, F.col("query_id").cast(self.kind), "query"))
        dealt = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "asks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, ids, block = None, [], [], None
            for batch in batches:
                keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
                cut = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
                for lo, hi in zip(cut, cut[1:], strict=False):
                    if lo == hi:
                        continue
                    cell, part, asks = keys[lo]
                    if (cell, part) != key:
                        key, held, ids, block = (cell, part), [], [], None
                    vectors = _units(_matrix(batch.column(5).slice(lo, hi - lo)))
                    if not asks:
                        held.append(vectors)
                        ids += batch.column(3).slice(lo, hi - lo).to_pylist()
                        continue
                    if block is None:
                        by_id = sorted(range(len(ids)), key=ids.__getitem__)
                        block, ids = np.concatenate(held)[by_id], [ids[i] for i in by_id]
                    names = batch.column(4).slice(lo, hi - lo).to_pylist()
                    out: list[list] = [[], [], []]
                    for first in range(0, len(names), 256):
                        p = score(vectors[first : first + 256] @ block.T)
                        for i, row in enumerate(p):
                            good = np.flatnonzero(row >= least)
                            good = good[np.argsort(-row[good], kind="stable")][: most + 1]  # ties by id; one more: the query itself may be among them
                            out[0] += [names[first + i]] * len(good)
                            out[1] += [ids[k] for k in good]
                            out[2] += row[good].tolist()
                    kind = batch.column(3).type
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], kind), pa.array(out[2], pa.float64())], names=["query_id", "id", "score"])

        return dealt.mapInArrow(run, f"query_id {self.kind}, id {self.kind}, score double").where("query_id <> id")

    def nearest(self, queries: DataFrame, most: int, least: float, score) -> DataFrame:
        """``(query_id, id, score, place)``: the ``most`` best rows of each of ``queries(query_id, query)``, ties by id.

        ``score`` maps cosines to scores and must not fall as they rise; rows under ``least`` do not count, nor a query's own id.
        """
        asked = saved(_usable(queries.toDF("id", "vector")).toDF("query_id", "query"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")
        top = lambda hits: hits.withColumn("place", place).where(F.col("place") <= most)
        first = saved(top(self._scan(saved(self._cells(asked, True, most, least, score)), most, least, score)))
        bars = first.where(F.col("place") == most).select("query_id", F.col("score").alias("bar"))
        barred = asked.join(bars, "query_id", "left").select("query_id", "query", F.coalesce("bar", F.lit(least)).alias("bar"))
        more = self._scan(saved(self._cells(barred, False, most, least, score)), most, least, score)
        return top(first.drop("place").union(more))


def _usable(vectors: DataFrame) -> DataFrame:
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("id").isNotNull())
    return rows.where((norm > 0) & (norm < float("inf")))
