"""Connected components of a table of links, by DataFrame operations only.

Large-star and small-star rounds: a round hangs the larger neighbours of a node, and then its smaller
ones, on the smallest. Links only ever move to smaller ends, hubs fold into one row per task before
they move, and the joins back are ones that adaptive execution splits. Rounds grow with the logarithm
of the longest path; each ends in a written table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import discard, shuffles_go, stored


def _state(links: DataFrame) -> tuple:
    with shuffles_go(links.sparkSession):
        row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first()
    return tuple(row)


def connected(links: DataFrame) -> DataFrame:
    """node, root: each node of links (a, b) with the smallest node that it reaches.

    ``a`` and ``b`` are longs; links with a null end or of a node with itself count for nothing. A
    smallest node has a row too. Without links the table is empty. It is read from a stored table, which
    ``discard`` of the result deletes.
    """
    current = stored(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        "links",
    )
    before = _state(current)
    while True:
        ends = current.select(F.col("lo").alias("node"), F.col("lo").alias("other")).unionByName(
            current.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
        )
        least = ends.groupBy("node").agg(F.min("other").alias("least"))
        large = current.join(least, current["lo"] == least["node"]).select("hi", F.col("least").alias("lo"))
        hung = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
        small = (
            large.join(hung, large["hi"] == hung["node"])
            .where(F.col("lo") != F.col("least"))
            .select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        )
        last, current = current, stored(
            small.unionByName(hung.select(F.col("node").alias("hi"), F.col("least").alias("lo"))).distinct(), "links"
        )
        discard(last)
        after = _state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    found = current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
    found.stored_path = current.stored_path
    return found


class Forest:
    """Links that a task has seen, folded into trees; a link inside a tree is not worth sending."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        parent = self.parent
        top = parent.setdefault(node, node)
        while parent[top] != top:
            parent[top] = parent[parent[top]]
            top = parent[top]
        parent[node] = top
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def links(self) -> tuple[list[int], list[int]]:
        """(node, root) of every node that is not its own root."""
        found = [(n, self.root(n)) for n in list(self.parent)]
        found = [(n, r) for n, r in found if n != r]
        return [n for n, _ in found], [r for _, r in found]
