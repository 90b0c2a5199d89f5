"""The pattern of a graph query: plain descriptions, no data."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field


@dataclass(frozen=True)
class QNode:
    key: str
    ids: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    is_set: bool = False
    option_group: str | None = None


@dataclass(frozen=True)
class QEdge:
    key: str
    subject: str
    object: str
    predicates: tuple[str, ...] = ()
    option_group: str | None = None
    exclude: bool = False


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[QNode, ...]
    edges: tuple[QEdge, ...] = field(default=())

    def __post_init__(self):
        keys = [n.key for n in self.nodes] + [e.key for e in self.edges]
        if len(set(keys)) != len(keys):
            raise ValueError("DuplicateKeys")
        names = {n.key for n in self.nodes}
        for e in self.edges:
            if e.subject not in names or e.object not in names:
                raise ValueError(f"UnknownQNodeKey: {e.key}")

    def node(self, key: str) -> QNode:
        return next(n for n in self.nodes if n.key == key)

    def required(self) -> Pattern:
        """Without optional and excluded edges, and without nodes only those use."""
        edges = tuple(e for e in self.edges if not e.exclude and e.option_group is None)
        used = {k for e in edges for k in (e.subject, e.object)}
        dropped = {k for e in self.edges if e not in edges for k in (e.subject, e.object)} - used
        return Pattern(tuple(n for n in self.nodes if n.key not in dropped and n.option_group is None), edges)

    def with_group(self, group: str) -> Pattern:
        """The required part and one option group."""
        base = self.required()
        edges = base.edges + tuple(e for e in self.edges if e.option_group == group and not e.exclude)
        used = {k for e in edges for k in (e.subject, e.object)} | {n.key for n in base.nodes}
        return Pattern(tuple(n for n in self.nodes if n.key in used), edges)

    def distances(self, start: str) -> dict[str, int]:
        """Steps from a node, ignoring direction."""
        near: dict[str, set[str]] = {n.key: set() for n in self.nodes}
        for e in self.edges:
            if e.subject != e.object:
                near[e.subject].add(e.object)
                near[e.object].add(e.subject)
        out, queue = {start: 0}, deque([start])
        while queue:
            k = queue.popleft()
            for other in sorted(near[k] - set(out)):
                out[other] = out[k] + 1
                queue.append(other)
        return out

    def check(self) -> None:
        """R2: a pattern with edges is connected, and an edge at an optional node is optional itself."""
        optional = {n.key for n in self.nodes if n.option_group is not None}
        bare = [e.key for e in self.edges if e.option_group is None and optional & {e.subject, e.object}]
        if bare:
            raise ValueError(f"MissingOptionalLabel: {', '.join(bare)}")
        if self.edges and len(self.distances(self.nodes[0].key)) < len(self.nodes):
            raise ValueError("DisconnectedQG")

    def essence_node(self) -> str:
        """The unpinned leaf, not set nor optional, farthest from the pinned nodes."""
        degree = {n.key: sum(n.key in (e.subject, e.object) for e in self.edges) for n in self.nodes}
        free = [n.key for n in self.nodes if not n.ids and not n.is_set and n.option_group is None]
        leaves = [k for k in free if degree[k] <= 1] or free or [self.nodes[0].key]
        pinned = [n.key for n in self.nodes if n.ids]
        far = {k: min((self.distances(p).get(k, 0) for p in pinned), default=0) for k in leaves}
        return max(leaves, key=lambda k: far[k])
