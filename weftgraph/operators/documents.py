"""Exports as whole documents: lines are made by Spark, in order, and written to one file as they come.

Only a partition's lines are on the driver at a time, except where a document is
small by nature (an overview, a canvas of 200 edges, a community's article).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.graph import Graph
from weftgraph.operators import export, metrics


def write_lines(lines: Iterable[str], path: str | Path) -> Path:
    """Writes lines beside the file and puts it in place at the end, so that a reader sees the old one or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    with part.open("w", encoding="utf-8") as f:
        for line in lines:
            f.write(line)
            f.write("\n")
    part.replace(path)
    return path


def _column(df: DataFrame, name: str) -> Iterator[str]:
    for row in df.select(name).toLocalIterator():
        yield row[0]


def _listed(values: Iterator[str]) -> Iterator[str]:
    """JSON values with commas between them."""
    last = None
    for v in values:
        if last is not None:
            yield last + ","
        last = v
    if last is not None:
        yield last


def graph_json(g: Graph, extra: dict | None = None) -> Iterator[str]:
    """Node-link JSON, a node or link a line, and further keys."""
    rows = export.node_link_json(g)
    yield '{"directed": false, "multigraph": false,'
    for part in ("nodes", "links"):
        yield f'"{part}": ['
        yield from _listed(_column(rows.filter(F.col("part") == part).orderBy("value"), "value"))
        yield "]," if part == "nodes" or extra else "]"
    for k, (name, value) in enumerate((extra or {}).items()):
        yield f"{json.dumps(name)}: {json.dumps(value, ensure_ascii=False)}" + ("," if k + 1 < len(extra) else "")
    yield "}"


def graphml(g: Graph) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="UTF-8"?>'
    yield '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
    for kind, keys in (("node", {"label": "string", "source_file": "string", "file_type": "string", "community": "int"}), ("edge", {"relation": "string", "confidence": "string"})):
        for name, type_ in keys.items():
            yield f'<key id="{name}" for="{kind}" attr.name="{name}" attr.type="{type_}"/>'
    yield '<graph id="G" edgedefault="undirected">'
    yield from _column(export.graphml(g).orderBy(F.desc("part"), "key"), "value")
    yield "</graph>"
    yield "</graphml>"


def cypher(g: Graph) -> Iterator[str]:
    yield from _column(export.cypher_nodes(g).orderBy("id"), "line")
    yield from _column(export.cypher_edges(g).orderBy("source", "target"), "line")


def svg(g: Graph, columns: int = 40, step: int = 120) -> Iterator[str]:
    """Circles on a grid with their labels, and lines between them; dashed ones aren't extracted."""
    at = export.svg_nodes(g, columns, step)
    n = g.nodes.count()
    yield f'<svg xmlns="http://www.w3.org/2000/svg" width="{min(n, columns) * step + step}" height="{(-(-n // columns)) * step + step}">'
    a, b = (at.select(F.col("id").alias(f"_{p}"), F.col("x").alias(f"x{p}"), F.col("y").alias(f"y{p}")) for p in "ab")
    e = g.edges.join(a, F.col("source") == F.col("_a")).join(b, F.col("target") == F.col("_b"))
    dash = F.when(F.col("confidence") == "EXTRACTED", F.lit("")).otherwise(F.lit(' stroke-dasharray="4 4"'))
    line = F.concat(F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d" stroke="#999"', F.col("xa") + step, F.col("ya") + step, F.col("xb") + step, F.col("yb") + step), dash, F.lit("/>"))
    yield from _column(e.orderBy("spos", "tpos").select(line.alias("line")), "line")
    label = T.svg_escape(F.col("label"))
    spot = F.concat(F.format_string('<circle cx="%d" cy="%d" r="', F.col("x") + step, F.col("y") + step), F.col("r").cast("string"), F.lit('" fill="'), "fill", F.lit('"/><text font-size="10" text-anchor="middle" x="'), (F.col("x") + step).cast("string"), F.lit('" y="'), (F.col("y") + step + 40).cast("string"), F.lit('">'), label, F.lit("</text>"))
    yield from _column(at.join(g.nodes.select("id", "label", "ord"), "id").orderBy("ord", "id").select(spot.alias("line")), "line")
    yield "</svg>"


def canvas(g: Graph, most: int = 200) -> str:
    """A canvas of boxes for communities, cards for members, three a row, and the heaviest edges."""
    names = export.vault_names(g.nodes)
    groups = [{"id": f"g{r['cid']}", "type": "group", "label": f"Community {r['cid']}", "x": r["x"], "y": r["y"], "width": r["width"], "height": r["height"]} for r in export.canvas_grid(g).orderBy("row", "col").collect()]
    place = {x["id"]: x for x in groups}
    cards, k = [], {}
    member = g.placed.filter("cid is not null").join(names, "id").orderBy("cid", F.desc("degree"), "id").select("id", "cid", "name")
    for r in member.toLocalIterator():
        box, i = place[f"g{r['cid']}"], k.get(r["cid"], 0)
        k[r["cid"]] = i + 1
        cards.append({"id": r["id"], "type": "file", "file": f"{r['name']}.md", "x": box["x"] + 20 + i % 3 * 190, "y": box["y"] + 80 + i // 3 * 100, "width": 180, "height": 80})
    edges = [{"id": f"e{i}", "fromNode": r["source"], "toNode": r["target"], "label": r["relation"]} for i, r in enumerate(export.canvas_edges(g, most).collect())]
    return json.dumps({"nodes": groups + cards, "edges": edges}, ensure_ascii=False)


def _folder(rows: DataFrame, folder: str | Path) -> int:
    """Writes (name, content) as files of a folder that all executors share; gives how many."""
    root = str(folder)

    def run(batches):
        import pandas as pd

        for b in batches:
            for name, content in zip(b["name"], b["content"]):
                write_lines([content], Path(root) / f"{name}.md")
            yield pd.DataFrame({"n": [len(b)]})

    Path(root).mkdir(parents=True, exist_ok=True)
    return rows.select("name", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]


def community_notes(g: Graph) -> DataFrame:
    """(name, content): a note for each community with its cohesion, members, links to other communities and bridges."""
    names = export.vault_names(g.nodes)
    item = lambda order, line: F.struct(order.alias("o"), line.alias("line"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["line"]), "\n")
    members = g.placed.filter("cid is not null").join(names, "id")
    m = members.groupBy("cid").agg(joined(item(F.concat(F.lpad((F.lit(10**12) - F.col("degree")).cast("string"), 13, "0"), F.col("id")), F.concat(F.lit("- [["), "name", F.lit("]]")))).alias("members"), F.count("*").alias("n"))
    b = metrics.between_communities(g)
    far = b.select(F.explode(F.array(F.struct(F.col("c1").alias("cid"), F.col("c2").alias("far")), F.struct(F.col("c2").alias("cid"), F.col("c1").alias("far")))).alias("p"), "edges").select("p.*", "edges")
    x = far.groupBy("cid").agg(joined(item(F.lpad((F.lit(10**12) - F.col("edges")).cast("string"), 13, "0"), F.concat(F.lit("- [[Community "), F.col("far").cast("string"), F.lit("]] ("), F.col("edges").cast("string"), F.lit(" edges)")))).alias("links"))
    br = metrics.bridges(g).join(names, "id").groupBy("cid").agg(joined(item(F.lpad(F.col("rank").cast("string"), 4, "0"), F.concat(F.lit("- [["), "name", F.lit("]]")))).alias("bridges"))
    c = metrics.cohesion(g).select("cid", "cohesion")
    out = m.join(c, "cid").join(x, "cid", "left").join(br, "cid", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit("none"))
    title = F.concat(F.lit("Community "), F.col("cid").cast("string"))
    return out.select(title.alias("name"), F.concat(F.lit("# "), title, F.lit("\n\n"), F.col("n").cast("string"), F.lit(" members, cohesion "), F.col("cohesion").cast("string"), F.lit("\n\n## Members\n"), "members", F.lit("\n\n## Links\n"), none("links"), F.lit("\n\n## Bridges\n"), none("bridges")).alias("content"))


def vault(g: Graph, folder: str | Path) -> int:
    """Notes of nodes and communities, and the colours of communities for the program that shows them."""
    n = _folder(export.vault_notes(g).unionByName(community_notes(g)), folder)
    cids = [r["cid"] for r in g.communities.select("cid").distinct().orderBy("cid").collect()]
    colours = [{"query": f'community:"Community {c}"', "color": {"a": 1, "rgb": int(T.PALETTE[c % 10][1:], 16)}} for c in cids]
    write_lines([json.dumps({"colorGroups": colours})], Path(folder) / ".obsidian" / "graph.json")
    return n


def wiki_pages(g: Graph, nodes: int = 25, links: int = 12, sources: int = 20) -> DataFrame:
    """(name, content): an article for each community with its best connected members, linked communities, sources and audit trail."""
    rows = export.wiki_articles(g, nodes, links)
    label = g.nodes.select(F.col("id").alias("value"), "label")
    joined = lambda line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n")
    m = rows.filter("part = 'node'").join(label, "value").groupBy("cid").agg(joined(F.concat(F.lit("- **"), "label", F.lit("** ("), F.col("n").cast("string"), F.lit(" edges)"))).alias("members"))
    x = rows.filter("part = 'link'").groupBy("cid").agg(joined(F.concat(F.lit("- [[Community_"), "value", F.lit("]] ("), F.col("n").cast("string"), F.lit(" edges)"))).alias("links"))
    s = g.placed.filter("cid is not null and source_file <> ''").groupBy("cid").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_set("source_file")), 1, sources), lambda p: F.concat(F.lit("- `"), p, F.lit("`"))), "\n").alias("files"))
    a = metrics.audit(g)
    c = metrics.cohesion(g).select("cid", "members", "cohesion").withColumnRenamed("members", "size")
    out = c.join(a, "cid").join(m, "cid").join(x, "cid", "left").join(s, "cid", "left")
    total = F.greatest(F.col("extracted") + F.col("inferred") + F.col("ambiguous"), F.lit(1))
    share = lambda k: F.concat(F.lit(f"- {k.upper()}: "), F.col(k).cast("string"), F.lit(" ("), F.round(F.col(k) * 100 / total).cast("int").cast("string"), F.lit("%)"))
    name = F.concat(F.lit("Community_"), F.col("cid").cast("string"))
    none = lambda c: F.coalesce(F.col(c), F.lit("none"))
    return out.select(
        name.alias("name"),
        F.concat(
            F.lit("# Community "), F.col("cid").cast("string"), F.lit("\n\n> "), F.col("size").cast("string"), F.lit(" nodes, cohesion "), F.col("cohesion").cast("string"), F.lit("\n\n## Key Concepts\n"), "members", F.lit("\n\n## Relationships\n"), none("links"),
            F.lit("\n\n## Source Files\n"), none("files"), F.lit("\n\n## Audit Trail\n"), share("extracted"), F.lit("\n"), share("inferred"), F.lit("\n"), share("ambiguous"), F.lit("\n\n[[index]]"),
        ).alias("content"),
    )


def god_pages(g: Graph, top: int = 10, each: int = 20) -> DataFrame:
    """(name, content): an article for each of the best connected nodes, its neighbours by relation."""
    gods = metrics.god_nodes(g, top)
    far = g.ends.join(F.broadcast(gods.select("id", F.col("label").alias("me"), F.col("degree").alias("d"))), "id").join(g.ranked.select(F.col("id").alias("other"), "label", "degree"), "other")
    line = F.concat(F.lit("- "), "label", F.lit(" ["), "confidence", F.lit("]"))
    by = far.groupBy("id", "me", "d", "relation").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("o"), F.col("other"), line.alias("line")))), 1, each).alias("rows"))
    part = F.concat(F.lit("### "), "relation", F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    out = by.groupBy("id", "me", "d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("relation", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("parts"))
    return out.select(T.wiki_name(F.col("me")).alias("name"), F.concat(F.lit("# "), "me", F.lit("\n\n> "), F.col("d").cast("string"), F.lit(" edges\n\n"), "parts", F.lit("\n\n[[index]]")).alias("content"))


def wiki(g: Graph, folder: str | Path) -> int:
    """Articles of communities and of the best connected nodes, and an index."""
    n = _folder(wiki_pages(g).unionByName(god_pages(g)), folder)
    size = g.communities.groupBy("cid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cid").collect()
    gods = metrics.god_nodes(g).select(T.wiki_name(F.col("label")).alias("name"), "degree").collect()
    lines = ["# Index", "", "## Communities", *(f"- [[Community_{r['cid']}]] ({r['n']} nodes)" for r in size), "", "## God Nodes", *(f"- [[{r['name']}]] ({r['degree']} edges)" for r in gods)]
    write_lines(lines, Path(folder) / "index.md")
    return n + 1


def push(g: Graph, send, batch: int = 100) -> int:
    """Cypher statements in batches of `batch` to send(list of statements), nodes before edges, one caller for each partition; gives how many were sent."""
    total = 0
    for lines in (export.cypher_nodes(g).select("line"), export.cypher_edges(g).select("line")):

        def run(batches):
            import pandas as pd

            for b in batches:
                held = b["line"].tolist()
                for s in range(0, len(held), batch):
                    send(held[s : s + batch])
                yield pd.DataFrame({"n": [len(held)]})

        total += lines.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    return total
