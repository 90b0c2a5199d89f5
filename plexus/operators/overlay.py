"""Overlays: statistics added to a graph as edge attributes or virtual edges.

Every overlay returns rows keyed by node pair; ``virtual_edges`` makes edges of them and ``attach`` an
attribute of existing edges.  Counts are distributed aggregations; pairs come from joins on shared
documents or intermediates, never from all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexus.functions.bitmaps import bitmaps, shared, shared_by_all
from plexus.functions.hypergeometric import fisher_p
from plexus.functions.order import ordered
from plexus.sources.scratch import saved

#: Fixed value: size of the literature for the distance.
NGD_N = 3.5e7 * 20


def ngd_value(fx: Column, fy: Column, fxy: Column, n: float = NGD_N) -> Column:
    """The normalized distance; null where a count is zero or missing."""
    lx, ly, lxy = F.log(fx.cast("double")), F.log(fy.cast("double")), F.log(fxy.cast("double"))
    value = (F.greatest(lx, ly) - lxy) / (F.log(F.lit(n)) - F.least(lx, ly))
    return F.when((fx > 0) & (fy > 0) & (fxy > 0), value)


def ngd(index: DataFrame, pairs: DataFrame, default: float = float("inf"), n: float = NGD_N, keep_docs: int = 30) -> DataFrame:
    """O1: ``pairs(subject, object)`` with ngd and up to ``keep_docs`` shared documents.

    ``index(concept, doc)``.  The asked concepts' documents become chunked bitmaps, and pairs meet chunk by chunk.
    """
    pairs = saved(pairs.select("subject", "object").distinct())
    asked = pairs.select(F.explode(F.array("subject", "object")).alias("concept")).distinct()
    maps, names = bitmaps(index.join(asked, "concept", "left_semi").select("concept", "doc"))
    count = maps.groupBy("concept").agg(F.sum("n").alias("f"))
    both = saved(shared(maps, pairs, keep_docs))
    docs = both.select("subject", "object", F.explode("firsts").alias("number")).join(names, "number")
    docs = docs.groupBy("subject", "object").agg(F.array_sort(F.collect_list("doc")).alias("docs"))  # at most keep_docs
    out = pairs.join(both.select("subject", "object", F.col("n").alias("fxy")), ["subject", "object"], "left").join(docs, ["subject", "object"], "left")
    out = out.join(count.toDF("subject", "fx"), "subject", "left").join(count.toDF("object", "fy"), "object", "left")
    return out.select("subject", "object", F.coalesce(ngd_value(F.col("fx"), F.col("fy"), F.col("fxy"), n), F.lit(default)).alias("ngd"), "docs")


def multi_ngd(index: DataFrame, groups: DataFrame, n: float = NGD_N) -> DataFrame:
    """O1m: distance of any number of concepts: ``groups(group_id, concept)``."""
    groups = saved(groups.select("group_id", "concept").distinct())
    maps, _ = bitmaps(index.join(groups.select("concept").distinct(), "concept", "left_semi").select("concept", "doc"))
    count = groups.join(maps.groupBy("concept").agg(F.sum("n").alias("f")), "concept", "left")
    ends = count.groupBy("group_id").agg(F.max("f").alias("most"), F.min("f").alias("least"), F.count("f").alias("found"), F.count(F.lit(1)).alias("k"))
    out = ends.join(shared_by_all(maps, groups), "group_id", "left")
    log = lambda c: F.log(F.col(c).cast("double"))
    value = (log("most") - log("shared")) / (F.log(F.lit(n)) - log("least"))
    return out.select("group_id", F.when((F.col("found") == F.col("k")) & (F.col("shared") > 0), value).alias("ngd"))


def jaccard(edges: DataFrame, start: DataFrame, middle: DataFrame, end: DataFrame) -> DataFrame:
    """O2: for each pair of a start and an end with a shared intermediate, shared / intermediates of the start.

    ``edges(a, b)`` in any direction.  Pairs without a shared intermediate have the value 0 and are left out;
    ``with_zeros`` adds them for a bounded number of ends.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("id", "mid")
    near = lambda ids: both.join(ids, "id", "left_semi").join(middle.select(F.col("id").alias("mid")), "mid", "left_semi")
    ends = near(end).select(F.col("id").alias("end"), "mid").distinct()
    starts = near(start.join(end, "id", "left_anti")).select(F.col("id").alias("start"), "mid").distinct()
    size = starts.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    shared = starts.join(ends, "mid").groupBy("start", "end").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(size, "start").select("start", "end", (F.col("shared") / F.col("n")).alias("jaccard_index"))


def with_zeros(found: DataFrame, starts: DataFrame, ends: DataFrame, most_ends: int = 1000) -> DataFrame:
    """All pairs of ``starts(start)`` and ``ends(end)`` with 0 where nothing is shared; ends are a bounded list."""
    ids = [r["end"] for r in ends.limit(most_ends + 1).collect()]
    if len(ids) > most_ends:
        raise ValueError(f"zeros are kept for at most {most_ends} ends")
    pairs = starts.withColumn("end", F.explode(F.array(*[F.lit(x) for x in ids])))
    return pairs.join(found, ["start", "end"], "left").fillna(0.0, ["jaccard_index"])


#: Subjects of a block: pairs are counted block by block.
BLOCK = 1024


def similar_neighbours(edges: DataFrame, least: float) -> DataFrame:
    """True Jaccard similarity of subjects by their objects, ``(a, b, similarity)`` with a < b, at least ``least``.

    Candidates share an object; a size bound prunes them before counting.  Subjects are numbered in their order and taken in
    blocks: the pairs of two blocks are made and counted in one task from lists, one per object and block, so no pair is moved.
    """
    e = saved(edges.select("subject", "object").where("subject is not null and object is not null").distinct())
    size = ordered(e.groupBy("subject").agg(F.count(F.lit(1)).alias("n")), ["subject"])
    size = saved(size.select(F.col("__ix").alias("k"), "subject", "n"))  # written: numbers stay
    at = e.join(size, "subject").where("object is not null").select("object", F.floor(F.col("k") / BLOCK).alias("block"), (F.col("k") % BLOCK).cast("int").alias("i"), F.col("n").cast("int"))
    lists = at.repartition("object").groupBy("object", "block").agg(F.collect_list(F.struct("i", "n")).alias("of"))
    left, right = lists.select("object", "block", F.col("of").alias("own")), lists.select("object", F.col("block").alias("other"), "of")
    met = left.where("size(own) > 1").select("block", F.col("block").alias("other"), "own.i", "own.n", *[F.lit(None).cast("array<int>").alias(x) for x in "jm"])
    met = met.union(left.join(right, "object").where("block < other").select("block", "other", "own.i", "own.n", "of.i", "of.n"))
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer where lists are small: pairs are not
    met = met.repartition(tasks, "block", "other").withColumns({"j": F.coalesce("j", "i"), "m": F.coalesce("m", "n")})
    pairs = met.select("block", "other", F.explode(F.arrays_zip("i", "n")).alias("l"), "j", "m").select("block", "other", "l", F.explode(F.arrays_zip("j", "m")).alias("r"))
    number = lambda block, i: F.col(block) * BLOCK + F.col(i)
    pairs = pairs.select("block", "other", number("block", "l.i").alias("ka"), number("other", "r.j").alias("kb"), F.col("l.n").alias("na"), F.col("r.m").alias("nb"))
    pairs = pairs.where((F.col("ka") < F.col("kb")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least))
    pairs = pairs.groupBy("block", "other", "ka", "kb", "na", "nb").agg(F.count(F.lit(1)).alias("m"))
    score = F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))
    found = pairs.withColumn("similarity", score).where(F.col("similarity") >= least).select("ka", "kb", "similarity")
    for k in "ab":
        found = found.join(size.select(F.col("k").alias(f"k{k}"), F.col("subject").alias(k)), f"k{k}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def fisher(links: DataFrame, degree: DataFrame, population: int, cutoff: float | None = None, top_n: int | None = None) -> DataFrame:
    """O3: enrichment p per object: ``links(subject, object)`` of the answer, ``degree(object, degree)`` in the whole graph.

    ``population`` is the number of nodes of the subject category.  Objects with a negative cell are skipped.
    O3b gives edge counts as degrees.
    """
    links = links.select("subject", "object").distinct()
    n = links.agg(F.countDistinct("subject").alias("n"))
    t = links.groupBy("object").agg(F.count(F.lit(1)).alias("a")).join(degree, "object").join(F.broadcast(n))  # one row
    t = t.withColumn("b", F.col("degree") - F.col("a")).withColumn("c", F.col("n") - F.col("a"))
    t = t.withColumn("d", F.lit(population) - F.col("degree") - F.col("c")).where("b >= 0 and c >= 0 and d >= 0")
    out = fisher_p(t.select("object", *[F.col(x).cast("long") for x in "abcd"]))
    if cutoff is not None:
        out = out.where(F.col("p") < cutoff)
    if top_n is not None:
        out = out.orderBy(F.round("p", 9), "object").limit(top_n)
    return out


def category_degree(edges: DataFrame, nodes: DataFrame, category: str) -> DataFrame:
    """``(object, degree)``: distinct neighbours of each node among nodes of ``category``, in any direction."""
    both = edges.select("subject", "object").union(edges.select("object", "subject")).toDF("near", "object").distinct()
    near = nodes.where(F.array_contains("categories", category)).select(F.col("id").alias("near"))
    return both.join(near, "near", "left_semi").groupBy("object").agg(F.count(F.lit(1)).alias("degree"))


def virtual_edges(pairs: DataFrame, label: str, predicate: str, attribute: str) -> DataFrame:
    """Virtual mode: one edge per pair, under a query edge of its own."""
    return pairs.select(
        F.concat_ws("--", F.lit(label), "subject", "object").alias("id"), "subject", F.lit(predicate).alias("predicate"), "object",
        F.lit(label).alias("qedge_key"), F.lit(attribute).alias("attribute"), F.col(attribute).cast("double").alias("value"))


def attach(edges: DataFrame, pairs: DataFrame, attribute: str, default: float) -> DataFrame:
    """Attribute mode: the pair's value on every existing edge between the two, in either direction."""
    one = pairs.select("subject", "object", attribute)
    two = pairs.select(F.col("object").alias("subject"), F.col("subject").alias("object"), attribute)
    value = one.union(two).groupBy("subject", "object").agg(F.min(attribute).alias(attribute))
    return edges.join(value, ["subject", "object"], "left").fillna(default, [attribute])


def result_pairs(result_nodes: DataFrame, first: str, second: str) -> DataFrame:
    """Distinct node pairs of two qnodes that occur in a result: ``result_nodes(result_id, qnode_key, node_id)``."""
    a = result_nodes.where(F.col("qnode_key") == first).select("result_id", F.col("node_id").alias("subject"))
    b = result_nodes.where(F.col("qnode_key") == second).select("result_id", F.col("node_id").alias("object"))
    return a.join(b, "result_id").select("subject", "object").distinct()


def inherited_group(groups: set[str | None]) -> str | None:
    """The option group of a virtual edge from those of its ends."""
    named = {g for g in groups if g}
    if len(named) > 1:
        raise ValueError("VirtualEdgeHasMultipleOptionGroups")
    return next(iter(named), None)


def inherited_groups(virtual: DataFrame, groups: DataFrame) -> DataFrame:
    """``(id, option_group, clash)``: the option group of each virtual edge ``(id, subject, object)``.

    ``groups(node_id, option_group)``: those of the nodes' query nodes, null for none.  ``clash``: the ends name several groups, so
    the edge gets none.
    """
    ends = virtual.select("id", F.explode(F.array("subject", "object")).alias("node_id"))
    named = ends.join(groups.where("option_group is not null").distinct(), "node_id")
    found = named.groupBy("id").agg(F.min("option_group").alias("lo"), F.max("option_group").alias("hi"))
    clash = F.coalesce(F.col("lo") < F.col("hi"), F.lit(False))
    return virtual.select("id").join(found, "id", "left").select("id", F.when(~clash, F.col("lo")).alias("option_group"), clash.alias("clash"))


def rebind(result_edges: DataFrame, result_nodes: DataFrame, virtual: DataFrame) -> DataFrame:
    """Virtual edges join the bindings of every result that binds both of their ends.

    ``result_edges(result_id, qedge_key, edge_id)``; the result has the same columns.
    """
    bound = result_nodes.select("result_id", "node_id").distinct()
    a = virtual.select("id", "subject", "object", "qedge_key").join(bound.withColumnRenamed("node_id", "subject"), "subject")
    new = a.join(bound.withColumnRenamed("node_id", "object"), ["result_id", "object"])
    return result_edges.union(new.select("result_id", "qedge_key", F.col("id").alias("edge_id"))).distinct()


def node_docs(index: DataFrame, ids: DataFrame, most: int | None = 100) -> DataFrame:
    """``(concept, docs)``: the first documents of each concept, ``most`` at most (None: all).

    Tasks keep ``most`` rows of a concept before the shuffle, and no list is longer.
    """
    docs = index.join(ids, "concept", "left_semi").select("concept", "doc").distinct()
    if most:
        place = F.row_number().over(Window.partitionBy("concept").orderBy("doc"))
        docs = docs.withColumn("__at", place).where(F.col("__at") <= most)
    return docs.groupBy("concept").agg(F.array_sort(F.collect_list("doc")).alias("docs"))


def pair_statistics(events: DataFrame) -> DataFrame:
    """The clinical pair table from ``events(patient, concept)``: counts, prevalence, expected count, ratio, chi square.

    One row per concept pair with ``concept_1 < concept_2`` that some patient has.
    """
    e = events.select("patient", "concept").distinct()
    patients = e.agg(F.countDistinct("patient").alias("n"))
    single = e.groupBy("concept").agg(F.count(F.lit(1)).alias("c"))
    left, right = e.toDF("patient", "concept_1"), e.toDF("patient", "concept_2")
    both = left.join(right, "patient").where("concept_1 < concept_2").groupBy("concept_1", "concept_2").agg(F.count(F.lit(1)).alias("c12"))
    t = both.join(single.toDF("concept_1", "c1"), "concept_1").join(single.toDF("concept_2", "c2"), "concept_2").join(F.broadcast(patients))  # one row
    n, c12, c1, c2 = (F.col(x).cast("double") for x in ("n", "c12", "c1", "c2"))
    expected = c1 * c2 / n
    only1, only2, neither = c1 - c12, c2 - c12, n - c1 - c2 + c12
    det = c12 * neither - only1 * only2
    margins = c1 * c2 * (n - c1) * (n - c2)
    return t.select(
        "concept_1", "concept_2", F.col("c12").alias("concept_count"), (c12 / n).alias("concept_frequency"), expected.alias("expected_count"),
        F.log(c12 / expected).alias("ln_ratio"), F.when(margins > 0, n * det * det / margins).otherwise(0.0).alias("chi_square"),
        (c12 / c1).alias("relative_frequency_1"), (c12 / c2).alias("relative_frequency_2"))


def clinical(pairs: DataFrame, mapping: DataFrame, table: DataFrame, measure: str) -> DataFrame:
    """The largest ``measure`` over all mapped concept pairs of ``pairs(subject, object)``; symmetric; with defaults.

    ``mapping(id, concept)``.  The pair table is joined on mapped concepts, so no pairs are enumerated.
    """
    swap = table.select(F.col("concept_2").alias("concept_1"), F.col("concept_1").alias("concept_2"), measure)
    both = table.select("concept_1", "concept_2", measure).union(swap)
    m1, m2 = mapping.toDF("subject", "concept_1"), mapping.toDF("object", "concept_2")
    hit = pairs.join(m1, "subject").join(m2, "object").join(both, ["concept_1", "concept_2"])
    best = hit.groupBy("subject", "object").agg(F.max(measure).alias(measure))
    default = {"concept_frequency": 0.0, "ln_ratio": float("-inf"), "chi_square": float("inf")}[measure]
    return pairs.join(best, ["subject", "object"], "left").select("subject", "object", F.coalesce(measure, F.lit(default)).alias(measure))


def clinical_p(pairs: DataFrame, mapping: DataFrame, table: DataFrame) -> DataFrame:
    """O4q: the p value of the mapped pair with the largest chi square."""
    swap = table.select(F.col("concept_2").alias("concept_1"), F.col("concept_1").alias("concept_2"), "chi_square", "p_value")
    both = table.select("concept_1", "concept_2", "chi_square", "p_value").union(swap)
    m1, m2 = mapping.toDF("subject", "concept_1"), mapping.toDF("object", "concept_2")
    hit = pairs.join(m1, "subject").join(m2, "object").join(both, ["concept_1", "concept_2"])
    best = hit.groupBy("subject", "object").agg(F.max(F.struct("chi_square", (-F.col("p_value")).alias("q"))).alias("b"))
    return best.select("subject", "object", (-F.col("b.q")).alias("p_value"))


def clinical_lookup(table: DataFrame, concept: str, order: str, other: str | None = None, domain: str | None = None) -> DataFrame:
    """Rows of a concept (with another, or with those of a domain), either way round, ordered by ``order`` descending.

    A concept's domain is what stands before its colon.  Ranks come from a global range sort.
    """
    swap = table.withColumns({"concept_1": F.col("concept_2"), "concept_2": F.col("concept_1"),
                              "relative_frequency_1": F.col("relative_frequency_2"), "relative_frequency_2": F.col("relative_frequency_1")})
    rows = table.unionByName(swap).where(F.col("concept_1") == concept)
    rows = rows.where(F.col("concept_2") == other) if other else rows
    rows = rows.where(F.substring_index("concept_2", ":", 1) == domain) if domain else rows
    at = ordered(rows.withColumn("__down", -F.col(order)), ["__down", "concept_2"])
    return at.withColumn("rank", F.col("__ix") + 1).drop("__down", "__ix")


def vocabularies(concepts: DataFrame) -> DataFrame:
    """C4: ``(vocabulary, n)``: the domains of ``concepts(concept)`` and how many concepts each has."""
    return concepts.distinct().groupBy(F.substring_index("concept", ":", 1).alias("vocabulary")).agg(F.count(F.lit(1)).alias("n"))


def get_concepts(concepts: DataFrame, ids: DataFrame) -> DataFrame:
    """C4: ``(concept, vocabulary, code)`` of the concepts named in ``ids(concept)``; unknown ones have no row."""
    known = concepts.select("concept").distinct().join(ids.select("concept").distinct(), "concept", "left_semi")
    return known.select("concept", F.substring_index("concept", ":", 1).alias("vocabulary"), F.substring_index("concept", ":", -1).alias("code"))


def map_ids(ids: DataFrame, mapping: DataFrame, distance: int | None = None) -> DataFrame:
    """``(id, concept, distance)`` of each id's mapped concepts, nearest first; ``mapping(id, concept, distance)``."""
    hit = mapping.join(ids.select("id").distinct(), "id", "left_semi")
    hit = hit.where(F.col("distance") <= distance) if distance is not None else hit
    return hit.groupBy("id", "concept").agg(F.min("distance").alias("distance"))


def domain_counts(events: DataFrame) -> DataFrame:
    """``(domain, patients, records)`` of ``events(patient, domain)``."""
    return events.groupBy("domain").agg(F.countDistinct("patient").alias("patients"), F.count(F.lit(1)).alias("records"))


def domain_pair_counts(events: DataFrame) -> DataFrame:
    """``(domain_1, domain_2, patients)``: patients with both domains.  Domains are few; a patient has each once."""
    e = events.select("patient", "domain").distinct()
    both = e.toDF("patient", "domain_1").join(e.toDF("patient", "domain_2"), "patient").where("domain_1 < domain_2")
    return both.groupBy("domain_1", "domain_2").agg(F.count(F.lit(1)).alias("patients"))


def patient_count(events: DataFrame) -> DataFrame:
    """``(patients, concepts, records)`` of the whole table."""
    return events.agg(F.countDistinct("patient").alias("patients"), F.countDistinct("concept").alias("concepts"), F.count(F.lit(1)).alias("records"))


def concept_frequency(events: DataFrame) -> DataFrame:
    """``(concept, concept_count, concept_frequency)`` over distinct patients."""
    e = events.select("patient", "concept").distinct()
    n = e.agg(F.countDistinct("patient").alias("n"))
    return e.groupBy("concept").agg(F.count(F.lit(1)).alias("concept_count")).join(F.broadcast(n)).select(  # one row
        "concept", "concept_count", (F.col("concept_count") / F.col("n")).alias("concept_frequency"))
