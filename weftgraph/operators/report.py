"""The report and the page for a browser: aggregates come to the driver, the graph doesn't.

Every list that a report shows is bounded by the report itself.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import is_concept_node, is_file_node
from weftgraph.graph import Graph
from weftgraph.operators import analyze, metrics


def report(g: Graph, title: str = "Graph", hyperedges: DataFrame | None = None, scan: DataFrame | None = None, tokens: tuple[int, int] = (0, 0)) -> str:
    """Markdown: corpus check, summary, hubs, best connected nodes, surprises, hyperedges if any, communities, doubtful edges, gaps and questions.

    Doubtful edges, hyperedges and communities are listed in full, as they are read for.
    """
    from weftgraph.sources.files import summary

    s, c = metrics.stats(g).head(), metrics.confidence_report(g).head()
    out = [f"# {title}", "", "## Corpus Check", ""]
    if scan is not None:
        t = summary(scan).head()
        out += [f"- {t['files']} files, about {t['words']:,} words", f"- {'a graph pays' if t['needs_graph'] else 'a graph may not be needed'}", *([f"- {t['warning']}"] if t["warning"] else [])]
    else:
        out.append("- files were not scanned")
    out += ["", "## Summary", "", f"- {s['nodes']} nodes, {s['edges']} edges, {s['communities']} communities", f"- {s['extracted_pct']}% extracted, {s['inferred_pct']}% inferred, {s['ambiguous_pct']}% ambiguous"]
    if c["inferred"]:
        out.append(f"- {c['inferred']} inferred edges (mean score {c['inferred_score']})")
    out.append(f"- tokens: {tokens[0]:,} in, {tokens[1]:,} out")
    coh = metrics.cohesion(g).join(metrics.overview(g).select("cid", "preview"), "cid").orderBy(F.desc("members"), "cid").collect()
    out += ["", "## Community Hubs", "", *(f"- [[Community {r['cid']}]]" for r in coh)]
    out += ["", "## God Nodes", ""]
    out += [f"{i}. `{r['label']}` - {r['degree']} edges" for i, r in enumerate(metrics.god_nodes(g).collect(), 1)] or ["None."]
    out += ["", "## Surprising Connections", ""]
    out += [f"- `{r['source']}` --{r['relation']}--> `{r['target']}` [{r['confidence']}]: {r['why']}" for r in analyze.connections(g).orderBy("rank").collect()] or ["None."]
    rows = hyperedges.collect() if hyperedges is not None else []
    if rows:
        out += ["", "## Hyperedges", "", *(f"- **{r['label']}**: {', '.join(r['nodes'])}" for r in rows)]
    out += ["", "## Communities", ""]
    out += [f"- Community {r['cid']}: {r['members']} nodes, cohesion {r['cohesion']}: {r['preview']}" for r in coh]
    out += ["", "## Ambiguous Edges", ""]
    out += [f"- `{r['source']}` --{r['relation']}--> `{r['target']}`" for r in g.edges.filter("confidence = 'AMBIGUOUS'").orderBy("spos", "tpos").toLocalIterator()] or ["None."]
    gaps = g.ranked.filter((F.col("degree") <= 1) & ~is_file_node() & ~is_concept_node()).count()
    thin = metrics.community_sizes(g).filter("thin").count()
    out += ["", "## Knowledge Gaps", "", f"- {gaps} weakly connected nodes", f"- {thin} thin communities", "", "## Suggested Questions", ""]
    out += [f"{r['rank']}. {r['question'] or r['why']}" for r in analyze.questions(g).orderBy("rank").collect()]
    return "\n".join(out) + "\n"


LARGE_NODES, LARGE_EDGES = 300, 900


def page_3d(g: Graph) -> str:
    """The page of nodes at their places of the layout, or of communities beyond LARGE_NODES nodes or LARGE_EDGES edges."""
    from weftgraph.operators.layout import layout

    if g.nodes.limit(LARGE_NODES + 1).count() > LARGE_NODES or g.edges.limit(LARGE_EDGES + 1).count() > LARGE_EDGES:
        return overview_page(g)
    at = {r["id"]: (r["x"], r["y"], r["z"]) for r in layout(g).collect()}
    n = g.placed.select("id", "label", "degree", "cid").orderBy("id").collect()
    e = g.edges.select("source", "target", "relation", "confidence").orderBy("source", "target").collect()
    nodes = [{"id": r["id"], "label": r["label"], "group": r["cid"] or 0, "size": 4 + r["degree"] ** 0.5 * 4, "at": at.get(r["id"], (0, 0, 0))} for r in n]
    return _page(nodes, [{"from": r["source"], "to": r["target"], "label": r["relation"], "dashes": r["confidence"] != "EXTRACTED"} for r in e])


def page(g: Graph, most_nodes: int = 5000) -> str:
    """A page with the graph as data and a small drawing script; a graph beyond most_nodes is refused, its overview takes its place."""
    if g.nodes.limit(most_nodes + 1).count() > most_nodes:
        raise ValueError(f"more than {most_nodes} nodes; draw overview_page instead")
    most = max(g.degree.agg(F.max("degree")).head()[0] or 1, 1)
    n = g.ranked.join(g.communities.withColumnRenamed("node_id", "id"), "id", "left").select("id", "label", "degree", "cid").collect()
    e = g.edges.select("source", "target", "relation", "confidence").collect()
    nodes = [{"id": r["id"], "label": r["label"], "group": r["cid"] or 0, "size": round(10 + 30 * r["degree"] / most, 1), "font": 12 if r["degree"] >= 0.15 * most else 0} for r in n]
    return _page(nodes, [{"from": r["source"], "to": r["target"], "label": r["relation"], "dashes": r["confidence"] != "EXTRACTED"} for r in e])


def overview_page(g: Graph) -> str:
    """The page of the communities, for graphs of any size."""
    n = metrics.overview(g).collect()
    e = metrics.between_communities(g).collect()
    return _page([{"id": r["cid"], "label": f"Community {r['cid']}: {r['preview']}", "group": r["cid"], "size": r["members"] ** 0.5} for r in n], [{"from": r["c1"], "to": r["c2"], "label": str(r["edges"]), "dashes": False} for r in e])


def _page(nodes: list[dict], edges: list[dict]) -> str:
    data = json.dumps({"nodes": nodes, "edges": edges}, ensure_ascii=False).replace("</", "<\\/")
    draw = "const g=JSON.parse(document.getElementById('data').textContent),c=document.querySelector('canvas').getContext('2d'),p={};g.nodes.forEach((n,i)=>{const t=i*2.4,r=12*Math.sqrt(i),s=n.at&&30/(30+n.at[2]);p[n.id]=n.at?[500+30*s*n.at[0],500+30*s*n.at[1]]:[500+r*Math.cos(t),500+r*Math.sin(t)]});for(const e of g.edges){c.setLineDash(e.dashes?[4,4]:[]);c.beginPath();c.moveTo(...p[e.from]);c.lineTo(...p[e.to]);c.stroke()}for(const n of g.nodes){c.beginPath();c.arc(...p[n.id],n.size/4,0,7);c.fill()}"
    return f'<!doctype html><meta charset="utf-8"><title>Graph</title><canvas width="1000" height="1000"></canvas><script id="data" type="application/json">{data}</script><script>{draw}</script>'
