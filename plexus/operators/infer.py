"""Inference over score tables and embeddings (I1-I7), and the archived path model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexus.functions.vectors import Index
from plexus.sources.scratch import saved


def top_scored(scores: DataFrame, side: str, ids: DataFrame, most: int = 50) -> DataFrame:
    """For each id on one side, its first ``most`` pairs ``(drug, disease, score)`` by score, ties by pair."""
    other = "disease" if side == "drug" else "drug"
    mine = scores.join(ids.select(F.col("id").alias(side)), side, "left_semi")
    place = F.row_number().over(Window.partitionBy(side).orderBy(F.desc("score"), other))
    return mine.withColumn("__r", place).where(F.col("__r") <= most).drop("__r")


def path_length(path):
    """Hops of ``id->pred->id->...``."""
    return F.floor(F.size(F.split(path, "->")) / 2).cast("long")


#: Fixed value: the predicate of a hop that stands for "no further hop".
SELF_LOOP = "SELF_LOOP_RELATION"


def surviving_paths(paths: DataFrame, edges: DataFrame, most: int = 25) -> DataFrame:
    """The first ``most`` paths of each pair all of whose hops are edges: ``paths(drug, disease, path, path_score)``.

    Each hop is looked up by an equi-join; a path is dropped with any hop missing.  A self-loop hop ends the path:
    the hops before it count.  ``option_group`` names the set of paths of one length, ``n_hops`` those that are bound.
    """
    place = F.row_number().over(Window.partitionBy("drug", "disease").orderBy(F.desc("path_score"), "path"))
    top = paths.withColumn("__r", place).where(F.col("__r") <= most).drop("__r")
    parts = F.split("path", "->")
    one = lambda i: F.struct(F.get("parts", (2 * i).cast("int")).alias("subject"), F.get("parts", (2 * i + 1).cast("int")).alias("predicate"), F.get("parts", (2 * i + 2).cast("int")).alias("object"))
    all_hops = F.transform(F.sequence(F.lit(0), F.floor(F.size("parts") / 2) - 1), one)
    loop = F.array_position(F.transform("hops", lambda h: h["predicate"]), SELF_LOOP)
    bound = F.when(loop > 0, F.slice("hops", 1, F.greatest(loop - 1, F.lit(0)).cast("int"))).otherwise(F.col("hops"))
    hops = top.withColumn("parts", parts).where(F.size("parts") > 2).withColumn("hops", all_hops).withColumn("bound", bound)
    hops = hops.select("drug", "disease", "path", F.floor(F.size("parts") / 2).alias("n"), F.size("bound").alias("n_hops"), F.explode("bound").alias("h"))
    hops = hops.select("drug", "disease", "path", "n", "n_hops", "h.*")
    found = hops.join(edges.select("subject", "predicate", "object"), ["subject", "predicate", "object"], "left_semi")
    whole = found.groupBy("drug", "disease", "path", "n", "n_hops").agg(F.count(F.lit(1)).alias("m")).where("m = n_hops")
    length = F.col("n").cast("long")
    return whole.select("drug", "disease", "path", length.alias("length"), F.concat(F.lit("paths_of_"), length.cast("string")).alias("option_group"), F.col("n_hops").cast("long").alias("n_hops"))


def predicted_edges(scored: DataFrame, survivors: DataFrame) -> DataFrame:
    """One predicted edge for each pair with a surviving path; for every scored pair if none has one."""
    pairs = survivors.groupBy("drug", "disease").agg(F.count(F.lit(1)).alias("n_paths"))
    none = survivors.limit(1).agg((F.count(F.lit(1)) == 0).alias("__none"))
    out = scored.join(pairs, ["drug", "disease"], "left").join(F.broadcast(none)).where("n_paths is not null or __none")  # one row
    return out.select(F.concat_ws("--", "drug", F.lit("predicted_treats"), "disease").alias("id"), "drug", "disease", "score", F.coalesce("n_paths", F.lit(0)).alias("n_paths"))


def source_chain(edges: DataFrame, own: str) -> DataFrame:
    """``sources`` from the primary source over the aggregators to ``own``, each once: ``edges(primary, aggregators, ...)``."""
    chain = F.concat(F.array("primary"), F.coalesce("aggregators", F.array().cast("array<string>")), F.array(F.lit(own)))
    return edges.withColumn("sources", F.array_distinct(F.filter(chain, lambda x: x.isNotNull())))


#: Kinds of regulation that can be asked for.
REGULATION = ("increased", "decreased")


def predicted_regulation(scores: DataFrame, regulation_type: str, subjects: DataFrame | None = None, objects: DataFrame | None = None, threshold: float = 0.5, most: int = 30) -> DataFrame:
    """I4: for each queried id the first ``most`` pairs ``(subject, object, regulation, score)`` of the asked kind, from the threshold up.

    Either ``subjects(id)`` or ``objects(id)`` are asked for; a query node may hold any number of ids.
    """
    if regulation_type not in REGULATION:
        raise ValueError(f"InvalidRegulationType: {regulation_type!r} is not among {REGULATION}")
    if (subjects is None) == (objects is None):
        raise ValueError("InvalidParams: name subjects or objects, not both")
    if not 0 <= threshold <= 1 or most < 1:
        raise ValueError("InvalidParams: threshold is 0 to 1, most at least 1")
    side, other, ids = ("subject", "object", subjects) if objects is None else ("object", "subject", objects)
    mine = scores.where((F.col("regulation") == regulation_type) & (F.col("score") >= threshold))
    mine = mine.join(ids.select(F.col("id").alias(side)).distinct(), side, "left_semi")
    place = F.row_number().over(Window.partitionBy(side).orderBy(F.desc("score"), other)).cast("long")
    return mine.withColumn("place", place).where(F.col("place") <= most).select("subject", "object", "regulation", "score", "place")


def by_prediction(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Results with their prediction score, missing as 0, best first."""
    return results.join(scores, "result_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).orderBy(F.desc("score"), "result_id")


def treat_probability(cosine: np.ndarray) -> np.ndarray:
    """I5's scorer: a fixed logistic of the cosine, to six digits."""
    return np.round(1 / (1 + np.exp(-5 * cosine)), 6)


def nearest(embeddings: DataFrame, queries: DataFrame, threshold: float = 0.5, most: int = 30) -> DataFrame:
    """``(query_id, vec_id, probability, place)``: for each query vector ``(query_id, query)`` the candidates
    ``embeddings(vec_id, embedding)`` with the highest probability, at least ``threshold``; ties by id.

    An index of cells with exact bounds (``functions.vectors``) finds them, not a comparison of all pairs.
    """
    index = Index(embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    found = index.nearest(queries.select("query_id", "query"), most, threshold, treat_probability)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("score").alias("probability"), "place")


def half_paths(ends: DataFrame, edges: DataFrame, hubs: DataFrame, depth: DataFrame, relevant: DataFrame) -> DataFrame:
    """The best way of one or two edges from each of ``ends(node)`` to each hub: ``(node, hub, way, mid, relevant)``.

    A way is as deep as its shallowest predicate.  Relevant ways come first -- one edge, or two over a node among
    ``relevant(id)`` -- then deep, then short ones, then those with the least edge ids.
    """
    both = edges.select("subject", "object", "predicate", "id").union(edges.select("object", "subject", "predicate", "id")).toDF("a", "b", "predicate", "id")
    both = both.where("a <> b").join(F.broadcast(depth), "predicate").select("a", "b", "depth", "id")  # a row per predicate
    best = lambda rows: rows.groupBy("a", "b").agg(F.max(F.struct("depth", "id")).alias("e")).select("a", "b", "e.depth", "e.id")
    # only edges at a hub or an end are compared, and those of an end where it is
    at_hub = both.join(hubs.select(F.col("id").alias("b")), "b", "left_semi").select(*both.columns)
    to_hub = best(at_hub).select(F.col("a").alias("near"), F.col("b").alias("hub"), F.col("depth").alias("d2"), F.col("id").alias("e2"))
    at_end = both.join(ends.select(F.col("node").alias("a")).distinct(), "a", "left_semi").select(*both.columns)
    start = best(at_end).select(F.col("a").alias("node"), F.col("b").alias("near"), F.col("depth").alias("d1"), F.col("id").alias("e1"))
    one = to_hub.withColumnRenamed("near", "node").join(ends.select("node").distinct(), "node", "left_semi").select(
        "node", "hub", F.lit(True).alias("relevant"), F.col("d2").alias("depth"), F.array("e2").alias("way"), F.lit(None).cast("string").alias("mid"))
    flagged = start.join(relevant.select(F.col("id").alias("near"), F.lit(True).alias("ok")).distinct(), "near", "left")
    two = flagged.join(to_hub, "near").where("node <> hub").select(
        "node", "hub", F.coalesce("ok", F.lit(False)).alias("relevant"), F.least("d1", "d2").alias("depth"), F.array("e1", "e2").alias("way"), F.col("near").alias("mid"))
    order = F.struct((~F.col("relevant")).alias("x"), (-F.col("depth")).alias("d"), F.size("way").alias("n"), "way", "mid")
    return one.union(two).groupBy("node", "hub").agg(F.min(order).alias("o")).select("node", "hub", "o.way", "o.mid", (~F.col("o.x")).alias("relevant"))


def via_hubs(answers: DataFrame, edges: DataFrame, hubs: DataFrame, depth: DataFrame, relevant: DataFrame, most: int = 10) -> DataFrame:
    """Paths answer - hub - target of one or two edges on either side of the hub.

    ``answers(answer, target)``, ``hubs(id)``, ``depth(predicate, depth)``.  Per pair the first ``most`` hubs: those
    with a relevant way on both sides first, then by id.  Answers, targets and edges between them are no hubs.
    """
    ends = answers.select(F.col("answer").alias("node")).union(answers.select("target")).distinct()
    best = half_paths(ends, edges, hubs, depth, relevant)
    left = best.toDF("answer", "hub", "way_1", "mid_1", "r1")
    right = best.toDF("target", "hub", "way_2", "mid_2", "r2")
    out = answers.join(left, "answer").join(right, ["target", "hub"]).where("hub <> answer and hub <> target")
    out = out.where("coalesce(mid_1, '') <> target and coalesce(mid_2, '') <> answer")
    out = out.withColumn("relevant", F.col("r1") & F.col("r2")).drop("r1", "r2")
    place = F.row_number().over(Window.partitionBy("answer", "target").orderBy(F.desc("relevant"), "hub")).cast("long")
    return out.withColumn("place", place).where(F.col("place") <= most)


def path_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bound nodes and edges of hub paths; a pair's ways of one and two edges bind query edges of their own.

    Answer ``n0``, its middle node ``n01``, the hub ``n1``, the target's middle node ``n12``, the target ``n2``.
    """
    spots = (("n0", "answer"), ("n01", "mid_1"), ("n1", "hub"), ("n12", "mid_2"), ("n2", "target"))
    nodes = found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("qnode_key"), F.col(c).alias("node_id")) for k, c in spots])).alias("x")).select("x.*")
    one = lambda side: found.select(F.size(f"way_{side}").alias("n"), F.posexplode(f"way_{side}").alias("pos", "edge_id")).select(
        F.concat(F.lit(f"e{side}_"), F.col("n").cast("string"), F.lit("_"), F.col("pos").cast("string")).alias("qedge_key"), "edge_id")
    return nodes.where("node_id is not null").distinct(), one(1).union(one(2)).distinct()


def transitions(paths: DataFrame) -> DataFrame:
    """First-order chain: row-normalized transition chances between categories of consecutive steps ``(from_type, to_type)``."""
    n = paths.groupBy("from_type", "to_type").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("from_type").agg(F.sum("n").alias("total"))
    return n.join(total, "from_type").select("from_type", "to_type", (F.col("n") / F.col("total")).alias("chance"))
