"""Graphs from and to storage: node-link JSON in its variants, and Parquet."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators.normalize import merge_edges, merge_nodes
from weftgraph.operators.ordering import number_rows


def _get(v: str, *names: str) -> Column:
    return F.coalesce(*[F.expr(f"try_variant_get({v}, '$.{n}', 'string')") for n in names])


def read_json(spark: SparkSession, path: str) -> Graph:
    """A graph of one JSON text or of several: an object with nodes and edges or links, or an array of such; records that lack what they need are skipped.

    Order of files, then of records, is the order of insertion.
    """
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.expr("try_parse_json(value)").alias("v"))
    rows = rows.filter(F.expr("v is not null"))
    many = F.expr("coalesce(try_variant_get(v, '$', 'array<variant>'), array(v))")
    parts = rows.select("file", F.posexplode(many).alias("part", "g"))
    lists = lambda n: F.expr(f"try_variant_get(g, '$.{n}', 'array<variant>')")
    key = ["file", "part", "at"]
    n = parts.select("file", "part", F.posexplode(lists("nodes")).alias("at", "r")).select(*key, _get("r", "id").alias("id"), _get("r", "label").alias("label"), F.coalesce(_get("r", "file_type"), F.lit("")).alias("file_type"), F.coalesce(_get("r", "source_file"), F.lit("")).alias("source_file"), F.coalesce(_get("r", "source_location"), F.lit("")).alias("source_location"), _get("r", "community").alias("community"))
    n = number_rows(n.filter("id is not null and label is not null"), [F.col(k) for k in key], "ord")
    e = parts.select("file", "part", F.posexplode(F.coalesce(lists("edges"), lists("links"))).alias("at", "r")).select(*key, _get("r", "source", "from").alias("source"), _get("r", "target", "to").alias("target"), _get("r", "relation").alias("relation"), _get("r", "confidence").alias("confidence"), F.coalesce(F.expr("try_variant_get(r, '$.weight', 'double')"), F.lit(1.0)).alias("weight"), F.expr("try_variant_get(r, '$.confidence_score', 'double')").alias("confidence_score"), _get("r", "_src").alias("src0"), _get("r", "_tgt").alias("tgt0"))
    e = e.filter("source is not null and target is not null and relation is not null and confidence is not null")
    nodes = merge_nodes(n.drop(*key))
    edges = merge_edges(nodes, e, [F.col(k) for k in key]).drop(*key)
    cid = F.expr("try_cast(community as bigint)")
    return Graph(nodes.drop("community"), edges, nodes.select(cid.alias("cid"), F.col("id").alias("node_id")).filter("cid is not null"))


def repo_tag(path: str) -> str:
    """The name of the folder two above a graph's file, as results lie in a folder of a repository; else of the one above."""
    parts = Path(path).resolve().parts
    return parts[-3] if len(parts) >= 4 else parts[-2]


def write_parquet(g: Graph, path: str) -> None:
    """Nodes by community, so that one community reads few files, with edges and communities beside them."""
    n = g.nodes.join(g.communities.withColumnRenamed("node_id", "id"), "id", "left") if g.communities is not None else g.nodes.withColumn("cid", F.lit(None).cast("bigint"))
    n.repartition("cid").sortWithinPartitions("cid", "id").write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_parquet(spark: SparkSession, path: str) -> Graph:
    n = spark.read.parquet(f"{path}/nodes")
    return Graph(n.drop("cid"), spark.read.parquet(f"{path}/edges"), n.filter("cid is not null").select("cid", F.col("id").alias("node_id")))


def from_rows(spark: SparkSession, nodes: list[dict], edges: list[dict], communities: dict[int, list[str]] | None = None) -> Graph:
    """A small graph of records, merged as any other."""
    full = [{"id": x["id"], "label": x.get("label", x["id"]), "file_type": x.get("file_type", "code"), "source_file": x.get("source_file", ""), "ord": i} for i, x in enumerate(nodes)]
    n = merge_nodes(spark.createDataFrame(full, "id string, label string, file_type string, source_file string, ord long"))
    rows = [{"source": x.get("source", x.get("from")), "target": x.get("target", x.get("to")), "relation": x.get("relation", "uses"), "confidence": x.get("confidence", "EXTRACTED"), "weight": float(x.get("weight", 1.0)), "at": i} for i, x in enumerate(edges)]
    e = spark.createDataFrame(rows, "source string, target string, relation string, confidence string, weight double, at long")
    c = spark.createDataFrame([(cid, m) for cid, ms in (communities or {}).items() for m in ms], "cid long, node_id string")
    return Graph(n, merge_edges(n, e, [F.col("at")]).drop("at"), c)


def model_reply(reply: str) -> dict:
    """Nodes and edges of a language model's reply: a code fence goes, edges count as INFERRED at 0.7 unless they say otherwise."""
    body = re.sub(r"^```\w*\s*|\s*```$", "", reply.strip())
    try:
        data = json.loads(body or "{}")
    except ValueError:
        data = {}
    nodes = [{**n, "node_type": n.get("node_type") or "concept"} for n in data.get("nodes", [])]
    edges = [{"confidence": "INFERRED", "confidence_score": 0.7, "weight": 0.0, **e} for e in data.get("edges", data.get("links", []))]
    return {"nodes": nodes, "edges": edges}

