"""Connected components of links, and edit distance within a band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmask.sources.lineage import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): of every node in the links, the least node that it is linked with, directly or over others.

    Each round takes every node's least neighbour and jumps to that one's root, so rounds grow with the logarithm of
    the longest chain; every round is cut with a reliable checkpoint, and links inside a component shrink away.
    Links to oneself and repeated links don't matter; without links the result is empty.
    """
    both = links.select(F.col(a).alias("_u"), F.col(b).alias("_v")).where("_u is not null and _v is not null")
    edges = cut(both.unionByName(both.select(F.col("_v").alias("_u"), F.col("_u").alias("_v"))).distinct())
    roots = cut(edges.groupBy("_u").agg(F.min("_v").alias("_m")).select(F.col("_u").alias("node"), F.least("_u", "_m").alias("root")))
    while True:
        jumped = roots.join(roots.select(F.col("node").alias("root"), F.col("root").alias("_far")), "root").select("node", F.col("_far").alias("root"), F.col("root").alias("_was"))
        near = edges.join(jumped.select(F.col("node").alias("_v"), F.col("root").alias("_r")), "_v").groupBy(F.col("_u").alias("node")).agg(F.min("_r").alias("_r"))
        # The root's own label falls with its members', so that whole components join at once.
        fell = jumped.join(near, "node").groupBy("root").agg(F.min(F.least("root", "_r")).alias("_low"))
        new = cut(jumped.join(fell, "root").select("node", F.col("_low").alias("root"), (F.col("_low") != F.col("_was")).alias("_moved")))
        roots = new.select("node", "root")
        if not new.where("_moved").limit(1).count():
            return roots


def within(a: str, b: str, k: int) -> int:
    """Edit distance (insert, delete, replace, swap of neighbours) if at most ``k``, else k + 1; fills a band of 2k + 1."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    far = k + 1
    before: list[int] = []
    row = [j if j <= k else far for j in range(m + 1)]
    for i in range(1, n + 1):
        new = [far] * (m + 1)
        if i <= k:
            new[0] = i
        x = a[i - 1]
        best = new[0]
        for j in range(max(1, i - k), min(m, i + k) + 1):
            v = row[j - 1] + (x != b[j - 1])
            if row[j] + 1 < v:
                v = row[j] + 1
            if new[j - 1] + 1 < v:
                v = new[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1] and before[j - 2] + 1 < v:
                v = before[j - 2] + 1
            new[j] = v
            best = min(best, v)
        if best > k:
            return far
        before, row = row, new
    return min(row[m], far)
