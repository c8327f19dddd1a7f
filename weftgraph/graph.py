"""The property graph: DataFrames of nodes, edges and communities.

nodes        id, label, file_type, source_file, ord (position of insertion, from data)
edges        source, target, relation, confidence, weight, src0, tgt0 (as written), spos, tpos (positions)
communities  cid, node_id

The graph is undirected and simple: one edge for an unordered pair, its ends in
order of position.  Degrees are derived once and shared by the operators.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    communities: DataFrame | None = None
    known_ranked: DataFrame | None = None  # nodes with degree and cid, where they are stored so
    known_both: DataFrame | None = None  # edges with the communities ca and cb of their ends
    codes: tuple[Callable[[Column], Column], Callable[[Column], Column]] | None = None  # code of an id, and id of a code: then known_ranked has `code`, known_both has `lo` and `hi` for source and target, one edge a pair and no loops

    def key(self, id: Column) -> Column:
        """What rows are joined by: the code of an id where there are codes, else the id."""
        return self.codes[0](id) if self.codes else id

    def name(self, key: Column) -> Column:
        """The id of a key."""
        return self.codes[1](key) if self.codes else key

    @cached_property
    def links(self) -> DataFrame:
        """Edges with the keys a and b of source and target."""
        if self.codes:
            return self.known_both.withColumnsRenamed({"lo": "a", "hi": "b"})
        return self.edges.withColumns({"a": F.col("source"), "b": F.col("target")})

    @cached_property
    def placed_links(self) -> DataFrame:
        """links, with the communities ca and cb of their ends; null for an end without."""
        return self.links if self.codes else self.both.withColumns({"a": F.col("source"), "b": F.col("target")})

    @cached_property
    def keyed(self) -> DataFrame:
        """Nodes with their key and degree."""
        if self.codes:
            return self.known_ranked.withColumnRenamed("code", "key")
        return self.ranked.withColumn("key", F.col("id"))

    def arcs(self, *more: str) -> DataFrame:
        """(key, other, ...) of every edge from each end, a loop twice."""
        e = F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("b").alias("other")), F.struct(F.col("b").alias("key"), F.col("a").alias("other"))))
        return self.links.select(e.alias("_e"), *more).select("_e.key", "_e.other", *more)

    @cached_property
    def neighbours(self) -> DataFrame:
        """(id, degree): how many different neighbours a node that has an edge has."""
        if self.codes:
            return self.degree
        return self.adjacency.groupBy("id").agg(F.count("*").alias("degree"))

    @cached_property
    def ends(self) -> DataFrame:
        """(id, other, ...): every edge once from each end; a loop appears twice.  One pass, no union."""
        e = F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other"))))
        rest = [c for c in self.edges.columns if c not in ("id", "other")]
        return self.edges.select(e.alias("_e"), *rest).select("_e.id", "_e.other", *rest)

    @cached_property
    def degree(self) -> DataFrame:
        """(id, degree) of nodes that have an edge; a loop counts twice."""
        if self.known_ranked is not None:
            return self.known_ranked.filter("degree > 0").select("id", "degree")
        return self.ends.groupBy("id").agg(F.count("*").alias("degree"))

    @cached_property
    def ranked(self) -> DataFrame:
        """Nodes with their degree, 0 without an edge."""
        if self.known_ranked is not None:
            return self.known_ranked.select(*self.nodes.columns, "degree")
        return self.nodes.join(self.degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))

    @cached_property
    def adjacency(self) -> DataFrame:
        """(id, other), distinct, both directions; a loop is its own neighbour once."""
        return self.ends.select("id", "other").distinct()

    @cached_property
    def placed(self) -> DataFrame:
        """Nodes with their degree and community; a null cid for those without."""
        if self.known_ranked is not None:
            return self.known_ranked
        return self.ranked.join(self.communities.select(F.col("node_id").alias("id"), "cid"), "id", "left")

    @cached_property
    def crossing(self) -> DataFrame:
        """(id, other, cid, far, ...): ends between nodes that have communities, from both sides."""
        both = self.both
        e = F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other"), F.col("ca").alias("cid"), F.col("cb").alias("far")), F.struct(F.col("target").alias("id"), F.col("source").alias("other"), F.col("cb").alias("cid"), F.col("ca").alias("far"))))
        rest = [c for c in self.edges.columns if c not in ("id", "other")]
        return both.select(e.alias("_e"), *rest).select("_e.*", *rest)

    @cached_property
    def crossing_keys(self) -> DataFrame:
        """(key, cid, far) of every edge from each end."""
        e = F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("ca").alias("cid"), F.col("cb").alias("far")), F.struct(F.col("b").alias("key"), F.col("cb").alias("cid"), F.col("ca").alias("far"))))
        return self.placed_links.select(e.alias("_e")).select("_e.*")

    @cached_property
    def both(self) -> DataFrame:
        """Edges with the communities ca and cb of their ends, null for an end without."""
        if self.known_both is not None:
            return self.known_both
        c = self.communities
        e = self.edges.join(c.select(F.col("node_id").alias("_a"), F.col("cid").alias("ca")), F.col("source") == F.col("_a"), "left")
        return e.join(c.select(F.col("node_id").alias("_b"), F.col("cid").alias("cb")), F.col("target") == F.col("_b"), "left").drop("_a", "_b")
