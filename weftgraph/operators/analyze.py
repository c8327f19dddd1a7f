"""Surprises and questions: what a reader should look at first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from weftgraph.functions.predicates import confidence_rank, is_concept_node, is_file_node, is_structural
from weftgraph.functions.text import file_category, top_folder
from weftgraph.graph import Graph
from weftgraph.operators.metrics import cohesion
from weftgraph.session import shared_checkpoints


#: Links that are looked at first for those between communities; ten times as many each further time.
FIRST = 1000


def _few(g: Graph, e: DataFrame, *cols: Column) -> DataFrame:
    """A few edges with columns of both ends, as a_ and b_ columns; the edges go to the nodes."""
    for p in "ab":
        n = g.keyed.select(F.col("key").alias(p), *cols)
        e = n.join(F.broadcast(e), p).withColumnsRenamed({c: f"{p}_{c}" for c in n.columns[1:]})
    return e


def _back() -> Column:
    """Whether an edge was written from its target."""
    return F.coalesce(F.col("src0") == F.col("target"), F.lit(False))


def _shown(a: str, b: str) -> Column:
    """The end that was written first."""
    return F.when(F.col("back"), F.col(b)).otherwise(F.col(a))


def surprises(g: Graph, top: int = 5) -> DataFrame:
    """(rank, source, target, relation, confidence, score, why): links across files, by how little they were to be expected.

    Reasons add up: doubtful confidence, other kinds of files, other folders,
    other communities, similarity (half as much again), a small node at a hub.
    Ties go by position.  Files, concepts and structural relations don't count.
    """
    e = g.placed_links if g.communities is not None else g.links.withColumns({"ca": F.lit(None).cast("bigint"), "cb": F.lit(None).cast("bigint")})
    e = e.filter(~is_structural()).select("a", "b", "relation", "confidence", _back().alias("back"), "spos", "tpos", F.col("ca").alias("a_cid"), F.col("cb").alias("b_cid"))
    n = g.keyed.filter((F.col("source_file") != "") & ~is_file_node() & ~is_concept_node()).select("key", "source_file", "degree")
    for p in "ab":  # labels and reasons are for the chosen ones only
        e = e.join(n.select(F.col("key").alias(p), F.col("source_file").alias(f"{p}_source_file"), F.col("degree").alias(f"{p}_degree")), p)
    e = e.filter(F.col("a_source_file") != F.col("b_source_file"))
    ka, kb = file_category(F.col("a_source_file")), file_category(F.col("b_source_file"))
    doubt = F.col("confidence").isin("AMBIGUOUS", "INFERRED")
    kinds, folders = ka != kb, top_folder(F.col("a_source_file")) != top_folder(F.col("b_source_file"))
    apart = F.coalesce(F.col("a_cid") != F.col("b_cid"), F.lit(False))
    alike = F.col("relation") == "semantically_similar_to"
    low, high = F.least("a_degree", "b_degree"), F.greatest("a_degree", "b_degree")
    edge_of_hub = (low <= 2) & (high >= 5)
    base = (3 - confidence_rank()) + F.when(kinds, 2).otherwise(0) + F.when(folders, 2).otherwise(0) + F.when(apart, 1).otherwise(0)
    score = F.when(alike, F.round(base * 1.5).cast("int")).otherwise(base) + F.when(edge_of_hub, 1).otherwise(0)
    small = F.when(F.col("a_degree") <= 2, F.col("a_label")).otherwise(F.col("b_label"))
    hub = F.when(F.col("a_degree") <= 2, F.col("b_label")).otherwise(F.col("a_label"))
    why = F.concat_ws(
        "; ",
        F.when(doubt, F.concat(F.lower("confidence"), F.lit(" connection - not explicitly stated in source"))),
        F.when(kinds, F.concat(F.lit("crosses file types ("), ka, F.lit(" ↔ "), kb, F.lit(")"))),
        F.when(folders, F.lit("connects across different repos/directories")),
        F.when(apart, F.lit("bridges separate communities")),
        F.when(alike, F.lit("semantically similar concepts with no structural link")),
        F.when(edge_of_hub, F.concat(F.lit("peripheral node `"), small, F.lit("` unexpectedly reaches hub `"), hub, F.lit("`"))),
    )
    order = [F.desc("score"), F.col("spos"), F.col("tpos")]
    top_ = _few(g, e.withColumn("score", score).orderBy(*order).limit(top), F.col("label"))
    out = top_.select("relation", "confidence", "spos", "tpos", "score", F.when(why == "", F.lit("cross-file semantic connection")).otherwise(why).alias("why"), _shown("a_label", "b_label").alias("source"), _shown("b_label", "a_label").alias("target"))
    return _number(out, order, top).select("rank", "source", "target", "relation", "confidence", "score", "why")


def _number(df: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first `top` rows with their rank; a top-k first, so that the numbering sees few rows."""
    return df.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def cross_community(g: Graph, top: int = 5) -> DataFrame:
    """(rank, source, target, relation, confidence, why): for each pair of communities its most doubtful link; most doubtful pairs first.

    Links are taken in that order, so that the first of a pair is its own: the
    first FIRST mostly hold enough pairs, and neither a sort nor a shuffle of all is needed.
    """
    shared_checkpoints(g.nodes.sparkSession)
    rank = confidence_rank()
    e = g.placed_links.filter(~is_structural() & (F.col("ca") != F.col("cb")))
    e = e.select("a", "b", "relation", "confidence", _back().alias("back"), "ca", "cb", F.struct(rank.alias("r"), "spos", "tpos", "a", "b").alias("o"))
    found: dict[tuple, Row] = {}
    size, rest = FIRST, e
    for _ in range(3):  # the first links in order, until they are of enough pairs
        rows = rest.orderBy("o").limit(size).checkpoint()
        every = _few(g, rows, is_file_node().alias("file"), F.col("label")).orderBy("o").collect()
        for r in every:
            if not (r["a_file"] or r["b_file"]) and len(found) < top:
                found.setdefault((min(r["ca"], r["cb"]), max(r["ca"], r["cb"])), r)
        if len(found) >= top or len(every) < size:
            break
        last = rows.agg(F.max("o").alias("_last"))
        rest = e.join(F.broadcast(last), F.col("o") > F.col("_last")).drop("_last")
        for lo, hi in found:
            rest = rest.filter((F.least("ca", "cb") != lo) | (F.greatest("ca", "cb") != hi))
        size *= 10
    else:  # hardly any link is of nodes that aren't files: look at the nodes of all that are left
        n = g.keyed.filter(~is_file_node()).select("key")
        for p in "ab":
            rest = rest.join(n.withColumnRenamed("key", p), p)
        best = rest.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min(F.struct("o", *[c for c in e.columns if c != "o"])).alias("m")).select("m.*")
        for r in _few(g, best.orderBy("o").limit(top - len(found)), F.col("label")).orderBy("o").collect():
            found[min(r["ca"], r["cb"]), max(r["ca"], r["cb"])] = r
    text = []
    for k, r in enumerate(found.values(), 1):
        shown = (r["b_label"], r["a_label"]) if r["back"] else (r["a_label"], r["b_label"])
        text.append((k, *shown, r["relation"], r["confidence"], f"Bridges community {r['ca']} → community {r['cb']}"))
    return g.nodes.sparkSession.createDataFrame(text, "rank int, source string, target string, relation string, confidence string, why string")


def connections(g: Graph, top: int = 5) -> DataFrame:
    """(rank, source, target, relation, confidence, why): surprises where nodes come from several files, else links between communities."""
    several = g.nodes.filter("source_file <> ''").select("source_file").distinct().limit(2).count() > 1
    return (surprises(g, top).drop("score") if several else cross_community(g, top)).select("rank", "source", "target", "relation", "confidence", "why")


def by_betweenness(g: Graph, top: int = 5, most_nodes: int = 5000) -> DataFrame:
    """(rank, source, target, relation, score) of the links that most shortest paths use; nothing for graphs beyond most_nodes."""
    from weftgraph.operators.centrality import edge_betweenness

    if g.nodes.limit(most_nodes + 1).count() > most_nodes:
        return g.edges.sparkSession.createDataFrame([], "rank int, source string, target string, relation string, score double")
    s = edge_betweenness(g).join(g.edges.select(F.col("source").alias("_s"), F.col("target").alias("_t"), "relation"), (F.col("source") == F.col("_s")) & (F.col("target") == F.col("_t")))
    order = [F.desc("score"), F.least("source", "target"), F.greatest("source", "target")]
    return _number(s, order, top).select("rank", "source", "target", "relation", "score")


def ambiguous_questions(g: Graph, top: int = 7) -> DataFrame:
    """Questions about AMBIGUOUS edges, in order of the edges.  Labels are joined to the few chosen edges only."""
    few = g.edges.filter("confidence = 'AMBIGUOUS'").orderBy("spos", "tpos").limit(top)
    n = g.nodes.select("id", "label")
    few = few.join(n.select(F.col("id").alias("_a"), F.col("label").alias("la")), F.col("source") == F.col("_a"), "left").join(n.select(F.col("id").alias("_b"), F.col("label").alias("lb")), F.col("target") == F.col("_b"), "left")
    text = F.concat(F.lit("What is the exact relationship between `"), F.coalesce("la", "source"), F.lit("` and `"), F.coalesce("lb", "target"), F.lit("`?"))
    why = F.concat(F.lit("Edge tagged AMBIGUOUS (relation: "), F.col("relation"), F.lit(") - confidence is low."))
    return few.select(F.row_number().over(Window.orderBy("spos", "tpos")).alias("rank"), F.lit("ambiguous_edge").alias("type"), text.alias("question"), why.alias("why"))


def inferred_questions(g: Graph, top: int = 5) -> DataFrame:
    """Of the best connected nodes that are no files, those with two INFERRED edges or more, with two of their neighbours."""
    best = g.ranked.filter(~is_file_node()).orderBy(F.desc("degree"), "ord").limit(top).select("id", "label", "degree", "ord")
    e = g.ends.filter("confidence = 'INFERRED'").join(F.broadcast(best.select("id", "label", "degree", "ord")), "id")
    n = g.nodes.select(F.col("id").alias("other"), F.col("label").alias("far"))
    w = Window.partitionBy("id").orderBy("spos", "tpos", "other")
    e = e.withColumns({"k": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("id"))}).filter("k <= 2 and n >= 2").join(n, "other")
    two = e.groupBy("id", "label", "degree", "ord", "n").agg(F.max(F.when(F.col("k") == 1, F.col("far"))).alias("x"), F.max(F.when(F.col("k") == 2, F.col("far"))).alias("y"))
    text = F.concat(F.lit("Are the "), F.col("n").cast("string"), F.lit(" inferred relationships involving `"), F.col("label"), F.lit("` (e.g. with `"), F.col("x"), F.lit("` and `"), F.col("y"), F.lit("`) actually correct?"))
    why = F.concat(F.lit("`"), F.col("label"), F.lit("` has "), F.col("n").cast("string"), F.lit(" INFERRED edges - model-reasoned connections that need verification."))
    return two.select(F.row_number().over(Window.orderBy(F.desc("degree"), "ord")).alias("rank"), F.lit("verify_inferred").alias("type"), text.alias("question"), why.alias("why"))


def isolated_questions(g: Graph) -> DataFrame:
    """One question about all nodes with one edge at most, naming the first three by position; no row if there are none."""
    n = g.ranked.filter((F.col("degree") <= 1) & ~is_file_node() & ~is_concept_node())
    first = n.orderBy("ord").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: F.concat(F.lit("`"), x["label"], F.lit("`"))), ", ").alias("names"))
    all_ = n.agg(F.count("*").alias("n"))
    text = F.concat(F.lit("What connects "), F.col("names"), F.lit(" to the rest of the system?"))
    why = F.concat(F.col("n").cast("string"), F.lit(" weakly-connected nodes found - possible documentation gaps or missing edges."))
    return first.crossJoin(all_).filter("n > 0").select(F.lit(1).alias("rank"), F.lit("isolated_nodes").alias("type"), text.alias("question"), why.alias("why"))


def low_cohesion_questions(g: Graph, below: float = 0.15, least: int = 5) -> DataFrame:
    """A question about each community of `least` members or more whose cohesion is lower than `below`."""
    c = cohesion(g).filter((F.col("cohesion") < below) & (F.col("members") >= least))
    text = F.concat(F.lit("Should `Community "), F.col("cid").cast("string"), F.lit("` be split into smaller, more focused modules?"))
    why = F.concat(F.lit("Cohesion score "), F.col("cohesion").cast("string"), F.lit(" - nodes in this community are weakly interconnected."))
    return c.select("cid", F.lit("low_cohesion").alias("type"), text.alias("question"), why.alias("why"))


def bridge_questions(g: Graph, top: int = 3, sources: int = 100) -> DataFrame:
    """Of the nodes on most shortest paths, those that touch other communities; sampled beyond 1 000 nodes."""
    from weftgraph.operators.centrality import node_betweenness

    scores = node_betweenness(g, None if g.nodes.limit(1001).count() <= 1000 else sources).filter("score > 0")
    best = g.ranked.join(scores, "id").filter(~is_file_node() & ~is_concept_node()).orderBy(F.desc("score"), "ord").limit(top).select("id", "label", "score", "ord")
    c = g.communities
    own = best.join(c.withColumnRenamed("node_id", "id"), "id")
    far = g.ends.join(F.broadcast(own), "id").join(c.select(F.col("node_id").alias("other"), F.col("cid").alias("far")), "other").filter("far <> cid")
    name = lambda x: F.concat(F.lit("`Community "), x.cast("string"), F.lit("`"))
    out = far.groupBy("id", "label", "score", "ord", "cid").agg(F.array_join(F.array_sort(F.collect_set(name(F.col("far")))), ", ").alias("others"))
    text = F.concat(F.lit("Why does `"), F.col("label"), F.lit("` connect "), name(F.col("cid")), F.lit(" to "), F.col("others"), F.lit("?"))
    why = F.format_string("High betweenness centrality (%.3f) - this node is a cross-community bridge.", "score")
    return out.select(F.row_number().over(Window.orderBy(F.desc("score"), "ord")).alias("rank"), F.lit("bridge_node").alias("type"), text.alias("question"), why.alias("why"))


def questions(g: Graph, top: int = 7) -> DataFrame:
    """(rank, type, question, why): all sections in their order, `top` in all (1 at least); one row no_signal if nothing is found."""
    low = low_cohesion_questions(g)
    parts = [ambiguous_questions(g, max(top, 1)), bridge_questions(g), inferred_questions(g), isolated_questions(g), low.withColumnRenamed("cid", "rank")]
    out = None
    for k, p in enumerate(parts):
        p = p.select(F.lit(k).alias("section"), F.col("rank").cast("bigint").alias("at"), "type", "question", "why")
        out = p if out is None else out.unionByName(p)
    out = out.orderBy("section", "at").limit(max(top, 1))
    none = out.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(9).alias("section"), F.lit(0).cast("bigint").alias("at"), F.lit("no_signal").alias("type"), F.lit(None).cast("string").alias("question"), F.lit("Too little signal: no doubtful edges, no bridges, and every community is cohesive.").alias("why"))
    return out.unionByName(none).select(F.row_number().over(Window.orderBy("section", "at")).alias("rank"), "type", "question", "why")
