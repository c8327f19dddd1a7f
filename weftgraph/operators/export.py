"""Exports as tables of lines or records, so that writing them is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.folding import norm_label
from weftgraph.functions.predicates import default_score
from weftgraph.graph import Graph
from weftgraph.operators.metrics import between_communities
from weftgraph.operators.ordering import number_rows


def _with_cid(g: Graph) -> DataFrame:
    return g.nodes.join(g.communities.withColumnRenamed("node_id", "id"), "id", "left")


def node_link_nodes(g: Graph) -> DataFrame:
    """(id, label, norm_label, file_type, source_file, community); null without a community."""
    return _with_cid(g).select("id", "label", norm_label(F.col("label")).alias("norm_label"), "file_type", "source_file", F.col("cid").alias("community"))


def node_link_links(g: Graph) -> DataFrame:
    """(source, target, relation, confidence, weight, confidence_score): weights to six digits, scores filled in."""
    score = F.coalesce("confidence_score", default_score()) if "confidence_score" in g.edges.columns else default_score()
    return g.edges.select("source", "target", "relation", "confidence", F.round("weight", 6).alias("weight"), score.alias("confidence_score"))


def node_link_json(g: Graph) -> DataFrame:
    """(part, value): one JSON text for each node and link."""
    n, e = node_link_nodes(g), node_link_links(g)
    return n.select(F.lit("nodes").alias("part"), F.to_json(F.struct(*n.columns), {"ignoreNullFields": "false"}).alias("value")).unionByName(e.select(F.lit("links").alias("part"), F.to_json(F.struct(*e.columns)).alias("value")))


def _props(pairs: list[tuple[str, Column]]) -> Column:
    items = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in sorted(pairs, key=lambda p: p[0])]
    return F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}"))


def cypher_nodes(g: Graph) -> DataFrame:
    """(id, line): a MERGE for each node, labelled by its file type."""
    kind = F.regexp_replace("file_type", "[^A-Za-z0-9_]", "")
    kind = F.when(kind == "", F.lit("unknown")).when(~kind.rlike("^[A-Za-z]"), F.lit("Entity")).otherwise(kind)
    q = lambda c: T.cypher_quote(F.col(c))
    line = F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: "), q("id"), F.lit("}) SET n += "), _props([(c, q(c)) for c in ("id", "label", "file_type", "source_file")]), F.lit(";"))
    return g.nodes.select("id", line.alias("line"))


def cypher_edges(g: Graph) -> DataFrame:
    """(source, target, line): a MATCH and MERGE for each edge."""
    rel = F.regexp_replace(F.upper("relation"), "[^A-Z0-9_]", "_")
    rel = F.when(rel == "", F.lit("RELATED_TO")).otherwise(rel)
    q = lambda c: T.cypher_quote(F.col(c))
    props = _props([("relation", q("relation")), ("confidence", q("confidence")), ("weight", F.col("weight").cast("string"))])
    line = F.concat(F.lit("MATCH (a {id: "), q("source"), F.lit("}), (b {id: "), q("target"), F.lit("}) MERGE (a)-[r:"), rel, F.lit("]->(b) SET r += "), props, F.lit(";"))
    return g.edges.select("source", "target", line.alias("line"))


def graphml(g: Graph) -> DataFrame:
    """(part, key, value): an element for each node and edge; community -1 without one."""
    x = lambda c: T.xml_escape(F.col(c))
    data = lambda k, v: F.concat(F.lit(f'<data key="{k}">'), v, F.lit("</data>"))
    cid = F.coalesce(F.col("cid").cast("string"), F.lit("-1"))
    node = F.concat(F.lit('<node id="'), x("id"), F.lit('">'), data("label", x("label")), data("source_file", x("source_file")), data("file_type", x("file_type")), data("community", cid), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), x("source"), F.lit('" target="'), x("target"), F.lit('">'), data("relation", x("relation")), data("confidence", x("confidence")), F.lit("</edge>"))
    return _with_cid(g).select(F.lit("node").alias("part"), F.col("id").alias("key"), node.alias("value")).unionByName(g.edges.select(F.lit("edge").alias("part"), F.concat_ws("|", "source", "target").alias("key"), edge.alias("value")))


def vault_names(nodes: DataFrame) -> DataFrame:
    """(id, name): a note for each node; labels that occur again get a running number."""
    w = Window.partitionBy("base").orderBy("ord", "id")
    n = nodes.select("id", "ord", T.note_name(F.col("label")).alias("base")).withColumn("k", F.row_number().over(w) - 1)
    return n.select("id", F.when(F.col("k") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("k").cast("string"))).alias("name"))


def vault_notes(g: Graph) -> DataFrame:
    """(name, content): the text of every node's note, with links to its neighbours by degree, then id."""
    names = vault_names(g.nodes)
    far = g.ends.join(names.select(F.col("id").alias("other"), "name"), "other").join(g.degree.select(F.col("id").alias("other"), "degree"), "other")
    line = F.concat(F.lit("- [["), "name", F.lit("]] - `"), "relation", F.lit("` ["), "confidence", F.lit("]"))
    item = F.struct((-F.col("degree")).alias("d"), F.col("other").alias("o"), line.alias("line"))
    links = far.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["line"]), "\n").alias("links"))
    head = F.concat(F.lit('---\nsource_file: "'), T.yaml_quote(F.col("source_file")), F.lit('"\ntype: "'), T.yaml_quote(F.col("file_type")), F.lit('"\ncommunity: "Community '), F.coalesce(F.col("cid").cast("string"), F.lit("None")), F.lit('"\n---\n\n# '), "label", F.lit("\n\n## Connections\n"))
    return _with_cid(g).join(names, "id").join(links, "id", "left").select("name", F.concat(head, F.coalesce("links", F.lit("none"))).alias("content"))


def canvas_grid(g: Graph, gap: int = 80) -> DataFrame:
    """(cid, col, row, x, y, width, height): communities on a square grid by size, each column as wide and each row as high as its largest."""
    size = g.communities.groupBy("cid").agg(F.count("*").alias("n"))
    at = number_rows(size, [F.desc("n"), F.col("cid")], "at")
    total = at.agg(F.ceil(F.sqrt(F.count("*").cast("double"))).cast("bigint").alias("cols"))
    height = F.greatest(F.lit(400).cast("bigint"), F.ceil(F.col("n") / 3.0).cast("bigint") * 100 + 120)
    b = at.crossJoin(total).select("cid", (F.col("at") % F.col("cols")).alias("col"), F.floor(F.col("at") / F.col("cols")).alias("row"), F.lit(600).cast("bigint").alias("width"), height.alias("height"))
    rows = b.groupBy("row").agg(F.max("height").alias("h"))
    tops = rows.withColumn("y", F.sum(F.col("h") + gap).over(Window.orderBy("row")) - F.col("h") - gap).select("row", "y")
    return b.join(tops, "row").select("cid", "col", "row", (F.col("col") * (600 + gap)).alias("x"), "y", "width", "height")


def canvas_edges(g: Graph, most: int = 200) -> DataFrame:
    """The heaviest edges, in order."""
    return g.edges.orderBy(F.desc("weight"), "spos", "tpos").limit(most).select("source", "target", "relation", "weight")


def wiki_articles(g: Graph, nodes: int = 25, links: int = 12) -> DataFrame:
    """(cid, part, rank, value, n): best connected members and most linked communities of each article."""
    n = g.placed.filter("cid is not null")
    w = Window.partitionBy("cid").orderBy(F.desc("degree"), "id")
    top = n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= nodes).select("cid", F.lit("node").alias("part"), "rank", F.col("id").alias("value"), F.col("degree").alias("n"))
    pairs = between_communities(g).select("c1", "c2", F.col("edges").alias("n"))  # few: a row for two communities
    x = pairs.select(F.explode(F.array(F.struct(F.col("c1").alias("cid"), F.col("c2").alias("far")), F.struct(F.col("c2").alias("cid"), F.col("c1").alias("far")))).alias("p"), "n").select("p.*", "n")
    v = Window.partitionBy("cid").orderBy(F.desc("n"), "far")
    far = x.withColumn("rank", F.row_number().over(v)).filter(F.col("rank") <= links).select("cid", F.lit("link").alias("part"), "rank", F.col("far").cast("string").alias("value"), "n")
    return top.unionByName(far)


def svg_nodes(g: Graph, columns: int = 40, step: int = 120) -> DataFrame:
    """(id, x, y, r, fill): nodes on a grid by position; radii follow degree."""
    at = number_rows(g.ranked, [F.col("ord"), F.col("id")], "at").join(g.communities.withColumnRenamed("node_id", "id"), "id", "left")
    most = g.degree.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    return at.crossJoin(most).select("id", (F.col("at") % columns * step).alias("x"), (F.floor(F.col("at") / columns) * step).alias("y"), F.round(F.lit(18.0) + F.col("degree") * 24.0 / F.coalesce("most", F.lit(1)), 1).alias("r"), T.colour(F.col("cid")).alias("fill"))
