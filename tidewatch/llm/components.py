"""Connected components of a table of links by contraction, without gathering links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.storage import released, sized, written

#: Links that one task ends with by union-find, at most: a few megabytes, whatever the table held at first.
LAST = 20_000


def components(links: DataFrame) -> DataFrame:
    """links(a, b), any comparable type -> (node, label): each node of a link with the smallest node of its component.

    Direction and repeats of links don't matter; links with a null end, and from a node to itself, say nothing and are left out. In a
    round every node moves to the node of least hash among itself and its neighbours; links then join what their ends moved to, loops
    and repeats vanish, and the next round goes on with the few links left. The hash is another one each round, so about half of the
    nodes go, whatever their names and however long a chain; a dense group is a single node after a round or two. The last LAST links are
    few enough for one task. Where a node ended is read off by following the moves back, smallest table first.
    """
    now = written(_tidy(links.where("a is not null and b is not null")), "links")
    moves = []
    while rows := now.count():
        if rows <= LAST:
            kind = dict(now.dtypes)["a"]
            moves.append(written(now.coalesce(1).mapInArrow(_rest, f"node {kind}, goal {kind}"), "moves"))
            break
        near = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        at = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), c).alias("h"), F.col(c).alias("n"))
        best = sized(near.groupBy("a").agg(F.min(at("b")).alias("best")), rows)
        move = written(best.select(F.col("a").alias("node"), F.least("best", at("a"))["n"].alias("goal")), "moves")
        ends = sized(now.join(move, now.a == move.node).select(F.col("goal").alias("a"), "b"), rows)
        ends = sized(ends.join(move, ends.b == move.node).select("a", F.col("goal").alias("b")), rows)
        after = written(sized(_tidy(ends), rows), "links")
        released(now)
        moves.append(move)
        now = after
    if not moves:
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    released(now)
    last = moves[-1]
    for move in moves[-2::-1]:
        onward = last.select(F.col("node").alias("via"), F.col("goal").alias("end"))
        last = move.join(onward, move.goal == onward.via, "left").select("node", F.coalesce("end", "goal").alias("goal"))
    ends = written(last, "ends")
    released(*moves)
    least = ends.groupBy("goal").agg(F.min("node").alias("label"))
    out = written(ends.join(least, "goal").select("node", "label"), "labels")
    released(ends)
    return out


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) -> (node, goal) by union-find."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kind = pa.null()
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "goal"])


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, smaller end first, without loops."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
