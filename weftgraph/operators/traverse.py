"""Search and traversal: level by level over the adjacency, with the visited set written at each level.

The driver loop runs once for a level, not for a node.  Every level is cut from
its lineage by checkpoint(), which outlives the loss of an executor.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.folding import fold_text, norm_label
from weftgraph.functions.predicates import relation_matches
from weftgraph.graph import Graph
from weftgraph.session import shared_checkpoints


def terms(question: str, least_bytes: int = 3) -> list[str]:
    """Folded words of a question, of least_bytes bytes or more."""
    return [fold_text(w.lower()).lower() for w in question.split() if len(w.encode()) >= least_bytes]


def search(g: Graph, words: list[str]) -> DataFrame:
    """(id, score): two for each word in the label, one for each in the path; nodes without any are left out."""
    label, source = norm_label(F.col("label")), F.lower("source_file")
    one = lambda c: c.cast("int")
    score = reduce(lambda a, b: a + b, [one(label.contains(w)) * 2 + one(source.contains(w)) for w in words], F.lit(0))
    return g.nodes.select("id", score.alias("score")).filter("score > 0")


def starts(g: Graph, words: list[str], top: int) -> DataFrame:
    """(id, score, rank) of the best hits; ties go to the later id."""
    w = Window.orderBy(F.desc("score"), F.desc("id"))
    return search(g, words).orderBy(F.desc("score"), F.desc("id")).limit(top).withColumn("rank", F.row_number().over(w))


#: Nodes of a level up to which it is sent to all tasks, so that the edges stay where they are.
MOST_SENT = 1_000_000


def _step(g: Graph, front: DataFrame, size: int, *more: str) -> DataFrame:
    """Arcs (key, other, ...) from a level of `size` nodes."""
    arcs = g.arcs(*more).filter("key <> other")
    return arcs.join(F.broadcast(front.select("key")) if size <= MOST_SENT else front.select("key"), "key")


def _fresh(found: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Found nodes that aren't in the levels before, of which only the last two can hold a neighbour.

    An outer join: an anti join would be moved below the join of edges and level, and all edges with it.
    """
    seen = reduce(DataFrame.unionByName, [df.select(F.col("key").alias("_s")) for df in levels[-2:]])
    return found.join(seen, F.col("key") == F.col("_s"), "left").filter("_s is null").drop("_s")


def _levels(g: Graph, start: DataFrame, depth: int, more: list[str]) -> list[DataFrame]:
    """(key, id, parent, ...) of each level; the parent is the neighbour of the level before with the smallest id, `more` are columns of the edge to it.  All but the last are written."""
    shared_checkpoints(start.sparkSession)
    levels = [start.select("id").distinct().select(g.key(F.col("id")).alias("key"), "id", F.lit(None).cast("string").alias("parent"), *[F.lit(None).cast("string").alias(c) for c in more]).checkpoint()]
    for level in range(1, depth + 1):
        size = levels[-1].count()
        step = _step(g, levels[-1].filter("key is not null"), size, *more)
        parent = g.name(F.col("key")).alias("parent")
        best = F.min(F.struct(parent, *more)) if more else F.min(parent)
        found = _fresh(step.groupBy(F.col("other").alias("key")).agg(best.alias("_b")), levels)
        found = found.select("key", g.name(F.col("key")).alias("id"), *([f"_b.{c}" for c in ("parent", *more)] if more else [F.col("_b").alias("parent")]))
        levels.append(found.checkpoint() if level < depth else found)
    return levels


def _ball(g: Graph, start: DataFrame, depth: int, more: list[str]) -> DataFrame:
    parts = [df.select("id", F.lit(k).alias("level"), "parent", *more) for k, df in enumerate(_levels(g, start, depth, more))]
    return reduce(DataFrame.unionByName, parts)


def ball(g: Graph, start: DataFrame, depth: int) -> DataFrame:
    """(id, level, parent): nodes within `depth` steps of the start ids, each at its first level.

    The parent is the neighbour of the level before with the smallest id, so
    that the tree doesn't depend on partitions.
    """
    return _ball(g, start, depth, [])


def tree(g: Graph, start: DataFrame, depth: int) -> DataFrame:
    """The ball; of a graph that has one edge a pair for sure, also with relation and confidence of the edge from the parent."""
    return _ball(g, start, depth, ["relation", "confidence"] if g.codes else [])


#: Nodes that a depth-first walk may have to choose from.
MOST_WALKED = 2_000_000


def dfs(g: Graph, start: list[str], depth: int, most: int = MOST_WALKED) -> DataFrame:
    """(id, at): nodes in the order of a depth-first walk with a stack, neighbours by id.

    The walk is sequential by nature; the ball of the same depth bounds it, and
    only that part of the graph comes to the one task that walks.  A ball of
    over `most` nodes is refused: ask for less depth, or for the ball.
    """
    spark = g.nodes.sparkSession
    s = spark.createDataFrame([(x,) for x in start], "id string").join(g.nodes.select("id"), "id", "left_semi")
    within = ball(g, s, depth).select("id").checkpoint()
    if within.limit(most + 1).count() > most:
        raise ValueError(f"over {most} nodes lie within {depth} steps; a depth-first walk of so many isn't made")
    part = g.adjacency.filter("id <> other").join(within, "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("near"))
    rows = within.join(part, "id", "left")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        near = {r.id: list(r.near) if r.near is not None else [] for r in pdf.itertuples()}
        seen: dict[str, int] = {}
        stack = [(x, 0) for x in reversed(start) if x in near]
        while stack:
            node, d = stack.pop()
            if node in seen or d > depth:
                continue
            seen[node] = len(seen)
            stack += [(y, d + 1) for y in near.get(node, []) if y not in seen]
        return pd.DataFrame({"id": list(seen), "at": list(seen.values())}, columns=["id", "at"])

    return rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(walk, "id string, at long")


def path(g: Graph, a: str, b: str) -> list[str] | None:
    """Ids along a shortest path from a to b, of any length, or None.

    Levels are walked from both ends, each time where the last one is smaller,
    until they meet; all shortest paths lead through nodes of both.  Walking
    back from b, a node's parent is its neighbour one step nearer to a with the
    smallest id, as if levels had been walked from a alone.
    """
    if a == b:
        return [a]
    spark = g.nodes.sparkSession
    shared_checkpoints(spark)
    ends = spark.createDataFrame([(a,), (b,)], "id string")
    sides = [[ends.filter(F.col("id") == x).select(g.key(F.col("id")).alias("key")).filter("key is not null").checkpoint()] for x in (a, b)]
    size, most = [1, 1], 1
    while True:
        k = 0 if size[0] <= size[1] else 1
        mine, other = sides[k], sides[1 - k]
        new = _fresh(_step(g, mine[-1], size[k]).select(F.col("other").alias("key")).distinct(), mine).checkpoint()
        size[k] = new.count()
        most = max(most, size[k])
        if not size[k]:
            return None
        mine.append(new)
        met = new.join(other[-1], "key", "left_semi").checkpoint()
        if not met.isEmpty():
            break
    ways = sides[0][:-1] + [met]  # nodes of shortest paths, or more, by their distance from a
    for level in sides[1][-2::-1]:
        near = g.arcs().join(F.broadcast(ways[-1]) if most <= MOST_SENT else ways[-1], "key").select(F.col("other").alias("key")).distinct()
        ways.append(level.join(near, "key", "left_semi").checkpoint())
    out = [b]
    for level in ways[-2::-1]:
        x = g.key(F.lit(out[-1]))
        beside = g.links.filter((F.col("a") == x) | (F.col("b") == x)).select(F.when(F.col("a") == x, F.col("b")).otherwise(F.col("a")).alias("key"))
        out.append(beside.join(level, "key", "left_semi").agg(F.min(g.name(F.col("key")))).head()[0])
    return out[::-1]


def find_node(g: Graph, label: str, top: int = 1) -> DataFrame:
    """Nodes whose folded label holds the text, or whose id is it: exact ids first, then exact labels, degree, id."""
    term = fold_text(label).lower()
    name = norm_label(F.col("label"))
    n = g.ranked.withColumn("_name", name).filter(F.col("_name").contains(term) | (F.lower("id") == term))
    return n.orderBy(F.desc(F.lower("id") == term), F.desc(F.col("_name") == term), F.desc("degree"), "id").limit(top).drop("_name")


def neighbours(g: Graph, node_id: str, relation: str | None = None) -> DataFrame:
    """(id, label, relation, confidence, degree) of the nodes next to one; the filter reaches the edges before any join."""
    e = g.edges.filter((F.col("source") == node_id) | (F.col("target") == node_id))
    if relation:
        e = e.filter(relation_matches(relation))
    e = e.select(F.when(F.col("source") == node_id, F.col("target")).otherwise(F.col("source")).alias("id"), "relation", "confidence")
    return g.ranked.join(e, "id").select("id", "label", "relation", "confidence", "degree")
