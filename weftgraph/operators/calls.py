"""Resolving calls and imports to nodes by equi-joins on lookup names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import call_keys
from weftgraph.operators.normalize import first_wins
from weftgraph.session import shared_checkpoints


#: Rows a side of a cell of imports and entities of one file.
CELL = 4000


def lookup_name(x: Column) -> Column:
    """The first of call_keys(x): trimmed of marks and brackets, lower case; null if nothing is left."""
    k = F.regexp_replace(F.trim(x), r"!+$", "")
    k = F.lower(F.regexp_replace(F.regexp_replace(k, r"^[()]+|[()]+$", ""), r"^\.+", ""))
    return F.when(k != "", k)


def label_index(nodes: DataFrame) -> DataFrame:
    """(key, target): the last node, by ord, of each lookup name."""
    n = nodes.select(lookup_name(F.col("label")).alias("key"), F.col("id").alias("target"), "ord").filter("key is not null")
    return first_wins(n, ["key"], [F.desc("ord")]).select("key", "target")


def unique(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys that have one value only."""
    return df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).filter("_a = _b").select(key, F.col("_a").alias(value))


def method_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, target): methods that are the only one of their name for their owner's name; key is owner::method."""
    n = nodes.select("id", lookup_name(F.col("label")).alias("name"))
    m = edges.filter("relation = 'method'").join(n.select(F.col("id").alias("_o"), F.col("name").alias("owner")), F.col("source") == F.col("_o")).join(n.select(F.col("id").alias("target_id"), F.col("name").alias("method")), F.col("target") == F.col("target_id"))
    return unique(m.select(F.concat("owner", F.lit("::"), "method").alias("key"), F.col("target_id").alias("target")), "key", "target")


def calls_in_files(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(source, target, relation, confidence, weight, ord) of calls whose callee is named in the caller's own file; the last label of a name, the first known key of a callee, one edge a pair."""
    named = nodes.select("source_file", lookup_name(F.col("label")).alias("key"), F.col("id").alias("target"), "ord").filter("key is not null and source_file <> ''")
    index = first_wins(named, ["source_file", "key"], [F.desc("ord")]).select("source_file", "key", "target")
    keys = calls.select("caller", "source_file", "ord", F.posexplode(call_keys(F.col("callee"))).alias("at", "key"))
    hit = keys.join(index, ["source_file", "key"]).groupBy("caller", "ord").agg(F.min_by("target", "at").alias("target")).filter("caller <> target")
    one = hit.groupBy("caller", "target").agg(F.min("ord").alias("ord"))
    return one.select(F.col("caller").alias("source"), "target", F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight"), "ord")


def receiver_targets(calls: DataFrame, returns: DataFrame, methods: DataFrame) -> DataFrame:
    """(call, caller, ord, target) of calls f().m() by the one type that f returns and the one method m there."""
    types = unique(returns.select(lookup_name(F.col("function_name")).alias("fn"), lookup_name(F.col("return_type_name")).alias("type")), "fn", "type")
    by = calls.withColumn("fn", lookup_name(F.col("receiver"))).join(types, "fn")
    return by.withColumn("key", F.concat("type", F.lit("::"), lookup_name(F.element_at(F.split("callee", r"::|->|[./]"), -1)))).join(methods, "key").select("call", "caller", "ord", "target")


def resolve_calls(nodes: DataFrame, edges: DataFrame, calls: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    """(source, target, relation, confidence, confidence_score, weight) of calls whose callee is a node's name.

    calls: (caller, callee, receiver, ord).  A callee's first key that is known
    counts; else the method of that name of the type that the receiver call
    returns, if both are unique.  Calls of oneself, and pairs that an edge
    already has in that direction, are left out; each pair appears once.
    """
    c = calls.withColumn("call", F.xxhash64("caller", "callee", "ord"))
    keys = c.select("call", "caller", "ord", F.posexplode(call_keys(F.col("callee"))).alias("at", "key"))
    hit = keys.join(label_index(nodes), "key").groupBy("call", "caller", "ord").agg(F.min_by("target", "at").alias("target"))
    found = hit.select("call", "caller", "ord", "target")
    if returns is not None:
        rest = c.filter("receiver is not null").join(found.select("call"), "call", "left_anti")
        found = found.unionByName(receiver_targets(rest, returns, method_index(nodes, edges)))
    found = found.filter("caller <> target")
    have = edges.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    new = found.join(have, (F.col("caller") == F.col("_s")) & (F.col("target") == F.col("_t")), "left_anti")
    one = new.groupBy("caller", "target").agg(F.min("ord").alias("ord"))
    return one.select(F.col("caller").alias("source"), "target", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("confidence_score"), F.lit(1.0).alias("weight"), "ord")


def import_uses(entities: DataFrame, imports: DataFrame, cell: int = CELL) -> DataFrame:
    """(source, target, line, relation, confidence, weight): every entity of a file uses what the file imports by name.

    entities: (id, label, module, source_file, kind), functions aside; imports:
    (source_file, module, name, line).  A module's name is its last segment; of
    entities that share module and label the last id counts.

    A row is a pair of an import and an entity of its file, and both are
    distinct before they meet, so that nothing is gathered after.  A file's
    pairs are dealt out in cells of `cell` imports or entities a side.
    """
    shared_checkpoints(entities.sparkSession)
    known = entities.groupBy("module", F.col("label").alias("name")).agg(F.max("id").alias("target"))
    local = entities.filter("kind <> 'function'").select(F.col("id").alias("source"), "source_file")
    met = imports.withColumn("module", F.substring_index("module", ".", -1)).join(known, ["module", "name"]).select("source_file", "target", "line")
    met, local = met.distinct().checkpoint(), local.distinct().checkpoint()
    shares = lambda df: df.groupBy("source_file").agg(F.ceil(F.count("*") / F.lit(float(cell))).cast("int").alias("n"))
    files = shares(met).withColumnRenamed("n", "m").join(shares(local), "source_file")
    deal = lambda df, own, other, at: df.join(files, "source_file").select("*", F.pmod(F.xxhash64(*at), F.col(own)).cast("int").alias(f"_{own}"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"_{other}")).drop("m", "n")
    out = deal(met, "m", "n", ["target", "line"]).join(deal(local, "n", "m", ["source"]), ["source_file", "_m", "_n"]).select("source", "target", "line")
    if not local.groupBy("source").count().filter("count > 1").isEmpty():  # an entity of several files may meet the same import in each
        out = out.distinct()
    return out.withColumns({"relation": F.lit("uses"), "confidence": F.lit("INFERRED"), "weight": F.lit(0.8)})
