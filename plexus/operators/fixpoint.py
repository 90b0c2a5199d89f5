"""Set semantics on any pattern: what is left when no node of a result is a dead end.

A node keeps its place in a result while, for every query node beside its own, the result holds a node
it is linked with.  The largest sets for which that holds everywhere are a greatest fixpoint.
On patterns without cycles they are the nodes of joint matches; on cycles they may be more, and there
may be no joint match at all.  Memberships are rows, so a result of any size stays spread out.

Sweeps of semi-joins run over the pattern inwards and back out.  Without a cycle among sets one sweep settles all;
else sweeps go on, each from a written table, until no row leaves.  A join over a link starts from the end
whose nodes have fewer partners.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.operators.multiway import Links, _between, bind
from plexus.plans.pattern import Pattern
from plexus.sources.scratch import saved


def _light(links: Links) -> dict[frozenset[str], str]:
    """The end of each link whose nodes have fewer partners: joins start from there."""
    counts, names = None, list(links)
    for i, (a, b) in enumerate(names):
        one = links[a, b].agg(F.lit(i).alias("i"), F.approx_count_distinct(a).alias("m"), F.approx_count_distinct(b).alias("n"))
        counts = one if counts is None else counts.union(one)
    rows = counts.collect() if counts is not None else []  # one row per link
    return {frozenset(names[r["i"]]): names[r["i"]][r["m"] < r["n"]] for r in rows}


def _supported(rows: DataFrame, a: str, other: DataFrame, b: str, pairs: DataFrame, keys: Sequence[str], light: str) -> DataFrame:
    """The ``rows`` of role ``a`` that have a partner in role ``b`` of their result."""
    if light == a:
        return rows.join(pairs, a).join(other, [*keys, b], "left_semi").select(*keys, a).distinct()
    if keys:
        near = other.join(pairs, b).select(*keys, a).distinct()
    else:
        near = pairs.join(other, b, "left_semi").select(a).distinct()
    return rows.join(near, [*keys, a], "left_semi").select(*keys, a)


def _written(roles: dict[str, DataFrame], keys: Sequence[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The roles, read from one written table, and that table."""
    rows = None
    for q, own in roles.items():
        part = own.select(F.lit(q).alias("__role"), *keys, F.col(q).alias("__node"))
        rows = part if rows is None else rows.union(part)
    rows = saved(rows)
    return {q: rows.where(F.col("__role") == q).select(*keys, F.col("__node").alias(q)) for q in roles}, rows


def _swept(roles: dict[str, DataFrame], links: Links, keys: Sequence[str], light: dict[frozenset[str], str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """One pass inwards and one back out.  A plan reads the role before it twice, so each pass is written."""
    order = _outwards(links, list(roles))
    for way in (order[::-1], [(b, a) for a, b in order]):
        roles = dict(roles)
        for a, b in way:
            roles[a] = _supported(roles[a], a, roles[b], b, _between(links, a, b), keys, light[frozenset((a, b))])
        roles, rows = _written(roles, keys)
    return roles, rows


def _outwards(links: Links, names: list[str]) -> list[tuple[str, str]]:
    """The links in the order of their distance from the first node, pointing outwards."""
    out, seen, left = [], [], list(links)
    for start in names:
        queue = [] if start in seen else [start]
        seen += queue
        for at in queue:
            for pair in [p for p in left if at in p]:
                left.remove(pair)
                other = pair[1] if pair[0] == at else pair[0]
                out.append((at, other))
                if other not in seen:
                    seen.append(other)
                    queue.append(other)
    return out


def _cyclic(links: Links) -> bool:
    up: dict[str, str] = {}

    def find(k: str) -> str:
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for a, b in links:
        if find(a) == find(b):
            return True
        up[find(a)] = find(b)
    return False


def consistent(roles: dict[str, DataFrame], links: Links, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The greatest fixpoint of ``roles``: no row of it lacks a partner over a link, in its result.

    ``roles[q]`` has the columns ``keys``, which name the result, and ``q``, a node; ``links`` are between roles.
    """
    if not links:
        return roles
    if keys:
        return _consistent_within(roles, links, keys)
    before, light = None, _light(links)
    while True:
        roles, rows = _swept(roles, links, keys, light)
        if not _cyclic(links):
            return roles
        now = {r["__role"]: r["n"] for r in rows.groupBy("__role").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per query node
        if now == before or not now:
            return roles
        before = now


#: Links that one task looks through; a result of more is swept by joins.
LOCAL = 250_000


def _alive(rows: pd.DataFrame, ends: list[tuple[int, int]]) -> pd.DataFrame:
    """The members of whole results, linked by ``rows(__i, __r, __a, __b)``, that no sweep removes; link i is between the roles ``ends[i]``."""
    result, names = pd.factorize(rows["__r"])
    nodes, many = pd.factorize(np.concatenate([rows["__a"].to_numpy(object), rows["__b"].to_numpy(object)]))
    link, n, roles = rows["__i"].to_numpy(), len(rows), max(max(e) for e in ends) + 1
    role = np.concatenate([np.array([e[side] for e in ends])[link] for side in (0, 1)])
    member, at = np.unique((np.concatenate([result, result]).astype(np.int64) * roles + role) * len(many) + nodes, return_inverse=True)
    a, b, kind = at[:n], at[n:], member // len(many) % roles
    alive, left = np.ones(len(member), bool), len(member) + 1
    while alive.sum() < left:
        left = alive.sum()
        for i, e in enumerate(ends):
            on = (link == i) & alive[a] & alive[b]
            has = np.zeros(len(member), bool)
            has[a[on]] = has[b[on]] = True
            alive &= has | ~np.isin(kind, e)
    member = member[alive]
    return pd.DataFrame({"__q": member // len(many) % roles, "__r": names[member // len(many) // roles], "__node": many[member % len(many)]})


def _consistent_within(roles: dict[str, DataFrame], links: Links, keys: Sequence[str]) -> dict[str, DataFrame]:
    """``consistent`` of many results: their own links are found once, and only those whose ends live go on.

    A link of two members of one result closes a triangle with the result, so ``multiway.bind`` finds it without
    all pairs of members and without all links of a member.  Results of at most ``LOCAL`` links are swept in one task each, many
    to a task, so their links are moved once; larger ones by joins.
    """
    result = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    of = {q: saved(rows.select(result.alias("__r"), q)) for q, rows in roles.items()}
    names = list(links)

    def written(tables: Links) -> Links:
        """The tables, read from one."""
        rows = None
        for i, (a, b) in enumerate(names):
            one = tables[a, b].select(F.lit(i).alias("__i"), "__r", F.col(a).alias("__a"), F.col(b).alias("__b"))
            rows = one if rows is None else rows.union(one)
        rows = saved(rows)
        counts.append({r["__i"]: r["n"] for r in rows.groupBy("__i").agg(F.count(F.lit(1)).alias("n")).collect()})  # one row per link
        return {(a, b): rows.where(F.col("__i") == i).select("__r", F.col("__a").alias(a), F.col("__b").alias(b)) for i, (a, b) in enumerate(names)}

    counts: list[dict[int, int]] = []
    own = written({(a, b): bind(["__r", a, b], {("__r", a): of[a], ("__r", b): of[b], (a, b): _between(links, a, b)}) for a, b in names})
    settled, kinds = {}, {rows.schema[c].dataType for rows in own.values() for c in rows.columns if c != "__r"}
    if len(keys) == 1 and len(kinds) == 1:
        settled, own = _settled(own, names, list(of))
    values = [F.col("__r").alias(keys[0])] if len(keys) == 1 else [F.col(f"__r.{k}").alias(k) for k in keys]
    if settled and own is None:
        return {q: settled.get(q, of[q]).select(*values, q) for q in of}
    while True:
        live = {}
        for q in of:
            rows = None
            for a, b in names:
                if q in (a, b):
                    near = own[a, b].select("__r", q).distinct()
                    rows = near if rows is None else rows.join(near, ["__r", q], "left_semi")
            live[q] = of[q] if rows is None else rows
        if len(counts) > 1 and counts[-1] == counts[-2]:
            break
        own = written({(a, b): own[a, b].join(live[a], ["__r", a], "left_semi").join(live[b], ["__r", b], "left_semi") for a, b in names})
    live = {q: rows.union(settled[q]) if q in settled else rows for q, rows in live.items()}
    return {q: rows.select(*values, q) for q, rows in live.items()}


def _settled(own: Links, names: list[tuple[str, str]], roles: list[str]) -> tuple[dict[str, DataFrame], Links | None]:
    """The members ``(__r, q)`` of results of at most ``LOCAL`` links by role, and the links of the others, if any."""
    ends, rows = [(roles.index(a), roles.index(b)) for a, b in names], None
    for i, (a, b) in enumerate(names):
        one = own[a, b].select(F.lit(i).alias("__i"), "__r", F.col(a).alias("__a"), F.col(b).alias("__b"))
        rows = one if rows is None else rows.union(one)
    size = rows.groupBy("__r").agg(F.count(F.lit(1)).alias("n"))
    total = size.agg(F.sum("n").alias("n"), F.max("n").alias("top")).first()
    rest, light = None, rows
    if (total["top"] or 0) > LOCAL:
        heavy = saved(size.where(F.col("n") > LOCAL).select("__r"))
        light = rows.join(heavy, "__r", "left_anti").select(*rows.columns)
        rest = {pair: table.join(heavy, "__r", "left_semi").select(*table.columns) for pair, table in own.items()}
    kind = rows.select(F.lit(0).cast("long").alias("__q"), "__r", F.col("__a").alias("__node")).schema

    def alive(part: pd.DataFrame) -> pd.DataFrame:
        return _alive(part, ends)

    bins = (total["n"] or 0) // LOCAL * 4 + 8
    done = saved(light.groupBy(F.pmod(F.xxhash64("__r"), F.lit(bins)).alias("bin")).applyInPandas(alive, kind))
    linked = {q for pair in names for q in pair}
    return {q: done.where(F.col("__q") == i).select("__r", F.col("__node").alias(q)) for i, q in enumerate(roles) if q in linked}, rest


def match_sets(pattern: Pattern, nodes: dict[str, DataFrame], links: Links) -> DataFrame:
    """One row per result, set-valued query nodes as sorted arrays; a result is named by its other nodes.

    ``nodes[q]`` has the column q; ``links`` the pairs of linked query nodes, all of them among ``nodes``, kept apart from their order.  The
    pattern is taken query node by query node, plain ones first where they are linked: a plain node makes new results of
    those it meets, a set takes the nodes that all linked query nodes reach.  Then dead ends leave.
    """
    sets = {n.key for n in pattern.nodes if n.is_set}
    plain = [n.key for n in pattern.nodes if not n.is_set]
    left, light = [n.key for n in pattern.nodes], _light(links)
    keys: list[str] = []
    roles: dict[str, DataFrame] = {}
    results: DataFrame | None = None
    while left:
        done = keys + list(roles)
        near = {q: [u for u in done if _between(links, q, u) is not None] for q in left}
        q = min(left, key=lambda q: (bool(done) and not near[q], q in sets, not any(u in keys for u in near[q])))
        left.remove(q)
        if not done:
            found = nodes[q].select(q).distinct()
        elif not plain:
            found = nodes[q].select(q).distinct()
        else:
            first, *others = sorted(near[q], key=lambda u: (u in sets, light[frozenset((q, u))] != u))
            found = (results if first in keys else roles[first]).join(_between(links, q, first), first).select(*keys, q).distinct()
            for u in others:
                if u in keys:
                    found = found.join(_between(links, q, u), [u, q], "left_semi").select(*keys, q)
                elif q not in sets:  # of two sets, those without a partner leave with the dead ends
                    found = _supported(found, q, roles[u], u, _between(links, q, u), keys, light[frozenset((q, u))])
        if q in sets:
            roles[q] = found
        else:
            results = found
            for r in roles:  # members go into every result that grows out of theirs
                grown = roles[r].join(results, keys)
                pairs = _between(links, q, r)
                if pairs is not None:
                    grown = grown.join(pairs, [q, r], "left_semi")
                roles[r] = grown.select(*keys, q, r)
            keys = [*keys, q]
    inner = {(a, b): pairs for (a, b), pairs in links.items() if a in sets and b in sets}
    roles = consistent(roles, inner, keys)
    for r, rows in roles.items():
        merged = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(r)).alias(r))
        merged = merged.where(F.size(r) > 0)
        results = merged if results is None else results.join(merged, keys) if keys else results.join(merged)  # one row each without keys
    return results.select(*[n.key for n in pattern.nodes])


def without_dead_ends(pattern: Pattern, kg_nodes: DataFrame, kg_edges: DataFrame, links: Links) -> tuple[DataFrame, DataFrame]:
    """The answer graph of any pattern without nodes and edges that are on no way through all of it.

    ``kg_nodes(qnode_key, node_id)``, ``kg_edges(qedge_key, id, subject, object)``, ``links`` as above.
    """
    roles = {n.key: kg_nodes.where(F.col("qnode_key") == n.key).select(F.col("node_id").alias(n.key)).distinct() for n in pattern.nodes}
    kept = consistent(roles, links)
    out = None
    for q, rows in kept.items():
        part = rows.select(F.lit(q).alias("qnode_key"), F.col(q).alias("node_id"))
        out = part if out is None else out.union(part)
    out = saved(out)  # read for each edge
    ends = lambda q, end: out.where(F.col("qnode_key") == q).select(F.col("node_id").alias(end))
    edges = None
    for e in pattern.edges:
        mine = kg_edges.where(F.col("qedge_key") == e.key)
        ways = [(e.subject, e.object), (e.object, e.subject)]
        both = None
        for s, o in ways:
            part = mine.join(ends(s, "subject"), "subject", "left_semi").join(ends(o, "object"), "object", "left_semi").select(*kg_edges.columns)
            both = part if both is None else both.union(part)
        both = both.distinct() if "map<" not in str(kg_edges.dtypes) else both.dropDuplicates(["qedge_key", "id"])
        edges = both if edges is None else edges.union(both)
    return out, edges
