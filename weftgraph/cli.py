"""The command line: python -m weftgraph.cli COMMAND ...

Questions read the graph of --graph (node-link JSON or a folder of Parquet, by
default kg-out/graph.json); stages read JSON from standard input or --input and
write to standard output or --output.
"""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import pipeline, server
from weftgraph.graph import Graph
from weftgraph.operators import cluster, documents, normalize, query
from weftgraph.operators import report as reports
from weftgraph.session import session
from weftgraph.sources import extract, files, graphs, ingest
from weftgraph.streaming import watch

QUESTIONS = ["what are the main components", "how does data flow through the system", "where are errors handled", "what depends on the core types", "how is configuration loaded"]


def load(spark: SparkSession, path: str) -> Graph:
    p = Path(path)
    if not p.exists():
        raise SystemExit(f"error: {path} not found; build a graph first")
    if p.is_dir():
        return graphs.read_parquet(spark, path)
    if p.suffix != ".json":
        raise SystemExit(f"error: {path} is no .json file")
    return graphs.read_json(spark, path)


def from_text(spark: SparkSession, text: str) -> Graph:
    """A graph of JSON text: an extraction, several of them, or a graph."""
    with tempfile.TemporaryDirectory() as d:  # read by this driver's own session before it goes
        path = Path(d) / "stage.json"
        path.write_text(text)
        g = graphs.read_json(spark, str(path))
        local = lambda df: spark.createDataFrame(df.collect(), df.schema)
        return Graph(local(g.nodes), local(g.edges), local(g.communities) if g.communities is not None else None)


def _json(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _clustered(g: Graph) -> Graph:
    return g if g.communities is not None and not g.communities.isEmpty() else Graph(g.nodes, g.edges, cluster.communities(g).checkpoint())


def benchmark(g: Graph, words: int | None, questions: list[str]) -> dict:
    rows = query.benchmark(g, questions, words).collect()
    if not rows:
        return {"error": "no question meets a node"}
    mean = sum(r["query_tokens"] for r in rows) // len(rows)
    n = g.nodes.count()
    corpus = rows[0]["corpus_tokens"]
    return {
        "corpus_tokens": corpus, "corpus_words": words if words is not None else n * 50, "nodes": n, "edges": g.edges.count(), "avg_query_tokens": mean, "reduction_ratio": round(corpus / max(mean, 1), 1),
        "per_question": [{"question": r["question"], "query_tokens": r["query_tokens"], "reduction": r["reduction"]} for r in rows],
    }


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph", description="Knowledge graphs of files and tables")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *names: str, graph: bool = True, **more):
        c = sub.add_parser(name, **more)
        if graph:
            c.add_argument("--graph", default=f"{pipeline.OUT}/graph.json")
        for n in names:
            c.add_argument(n)
        return c

    c = add("query", "question")
    c.add_argument("--dfs", action="store_true")
    c.add_argument("--depth", type=int, default=2)
    c.add_argument("--budget", type=int, default=2000)
    c = add("path", "source", "target", aliases=["shortest-path"])
    c.add_argument("--max-hops", type=int)
    add("explain", "label")
    add("neighbors", "label").add_argument("--relation")
    add("community", "cid")
    add("god-nodes").add_argument("--top", type=int, default=10)
    add("stats")
    c = add("benchmark", aliases=["benchmark-json"])
    c.add_argument("--words", type=int)
    c.add_argument("--question", action="append")
    add("serve")
    add("check-update", graph=False).add_argument("folder", nargs="?", default=pipeline.OUT)
    for name in ("update", "rebuild-code", "watch", "detect", "detect-incremental"):
        c = add(name, graph=False)
        c.add_argument("root", nargs="?", default=".")
        c.add_argument("--out")
        c.add_argument("--ignore", action="append", default=[])
        c.add_argument("--wiki", action="store_true")
        c.add_argument("--follow-symlinks", action="store_true")
        c.add_argument("--debounce", type=float, default=3.0)
        c.add_argument("--manifest", default=f"{pipeline.OUT}/manifest")
    add("cluster-only", graph=False).add_argument("folder", nargs="?", default=pipeline.OUT)
    c = add("merge-graphs", graph=False)
    c.add_argument("paths", nargs="+")
    c.add_argument("--output")
    add("extract", graph=False).add_argument("paths", nargs="+")
    for name in ("build", "cluster", "analyze", "report", "validate", "export-json", "export-cypher", "export-graphml", "export-html", "export-html-3d", "export-svg", "export-canvas", "export-vault", "export-wiki", "export-push"):
        c = add(name, graph=False)
        c.add_argument("--input")
        c.add_argument("--output")
        c.add_argument("--url")
    c = add("diff", "old", "new", graph=False)
    c = add("save-result", "question", "answer", graph=False)
    c.add_argument("--folder", default=f"{pipeline.OUT}/memory")
    c.add_argument("--kind", default="query")
    c.add_argument("--node", action="append", default=[])
    c = add("add", "url", graph=False)
    c.add_argument("--folder", default="raw")
    c.add_argument("--author")
    c.add_argument("--contributor")
    return p


def answer(spark: SparkSession, a: argparse.Namespace) -> str | None:
    """The text of a command, or None if it wrote its own."""
    name = a.command
    if name in ("query", "path", "shortest-path", "explain", "neighbors", "community", "god-nodes", "stats", "benchmark", "benchmark-json", "serve"):
        g = load(spark, a.graph)
        if name == "query":
            return query.ask(g, a.question, a.depth, a.budget, a.dfs)
        if name in ("path", "shortest-path"):
            return query.path_text(g, a.source, a.target, a.max_hops)
        if name == "explain":
            return query.explain(g, a.label)
        if name == "neighbors":
            return query.neighbors(g, a.label, a.relation)
        if name == "community":
            return query.community(g, int(a.cid))
        if name == "god-nodes":
            return query.god_nodes(g, a.top)
        if name == "stats":
            return query.stats(g)
        if name == "serve":
            server.serve(g)
            return None
        return json.dumps(benchmark(g, a.words, a.question or QUESTIONS), indent=2)
    if name == "check-update":
        return pipeline.update_text(a.folder)
    if name in ("update", "rebuild-code"):
        b = pipeline.rebuild(spark, a.root, a.out, a.ignore, a.wiki)
        return f"Rebuilt: {b.nodes} nodes, {b.edges} edges, {b.communities} communities in {b.folder}" + ("" if b.replaced else "\nThe graph in place is larger and stays; remove it if that is meant.")
    if name == "cluster-only":
        b = pipeline.recluster(spark, a.folder)
        return f"Clustered: {b.nodes} nodes, {b.communities} communities"
    if name == "watch":
        watch.poll(spark, a.root, lambda changed: print(f"{len(changed)} file(s) changed: " + _on_change(spark, a, changed), flush=True), seconds=a.debounce)
        return None
    if name == "detect":
        found = files.scan(spark, a.root, a.ignore)
        t = files.summary(found).head().asDict()
        return json.dumps({**t, "total_files": t["files"], "files": {r["file_type"]: sorted(r["paths"]) for r in found.groupBy("file_type").agg(F.collect_list("path").alias("paths")).collect()}, "by_type": _json(files.totals(found))}, indent=2)
    if name == "detect-incremental":
        found = files.scan(spark, a.root, a.ignore)
        manifest = files.load_manifest(spark, a.manifest) if Path(a.manifest).exists() else spark.createDataFrame([], "path string, mtime double")
        return json.dumps({r["state"]: sorted(r["paths"]) for r in watch.incremental(found, manifest).groupBy("state").agg(F.collect_list("path").alias("paths")).collect()}, indent=2)
    if name == "extract":
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(a.paths).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), files.decoded(F.col("content")).alias("text"))
        rows = rows.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin("py", *extract.LANGUAGES))
        n, e = extract.code_graph(extract.extract(rows))
        return json.dumps({"nodes": _json(n.orderBy("ord")), "edges": _json(e.orderBy("ord"))}, indent=2)
    if name == "merge-graphs":
        if len(a.paths) < 2:
            raise SystemExit("error: at least two graphs are needed")
        loaded = [(graphs.repo_tag(p), load(spark, p)) for p in a.paths]
        n, e = normalize.union_graphs([(tag, g.nodes, g.edges.withColumn("ord", F.col("spos")).drop("spos", "tpos")) for tag, g in loaded])
        n = n.withColumn("ord", F.col("part") * (1 << 40) + F.col("ord")).drop("part")
        g = Graph(n, normalize.merge_edges(n, e, ["part", "ord"]).drop("part", "repo"))
        n, e = normalize.merge_labels(g.nodes, g.edges)
        return _out(a.output, documents.graph_json(_clustered(Graph(n, e))))
    if name == "diff":
        old, new = load(spark, a.old), load(spark, a.new)
        parts = normalize.diff((old.nodes, old.edges), (new.nodes, new.edges))
        return json.dumps({"summary": normalize.diff_summary(*parts).head()["summary"], "nodes": _json(parts[0]), "edges": _json(parts[1])}, indent=2)
    if name == "save-result":
        return str(pipeline.save_answer(a.question, a.answer, a.folder, a.kind, a.node))
    if name == "add":
        path, kind = ingest.add_url(a.url, a.folder, a.author, a.contributor)
        return f"{kind}: {path}"
    return _stage(spark, a)


def _on_change(spark: SparkSession, a: argparse.Namespace, changed: dict[str, str]) -> str:
    folder = a.out or str(Path(a.root) / pipeline.OUT)
    if any(kind != "code" for kind in changed.values()):
        return f"other files than code among them, marked in {pipeline.flag_update(folder)}"
    b = pipeline.rebuild(spark, a.root, folder, a.ignore)
    return f"rebuilt, {b.nodes} nodes, {b.edges} edges"


def _out(path: str | None, lines) -> str | None:
    if path:
        documents.write_lines(lines, path)
        return None
    return "\n".join(lines)


def _stage(spark: SparkSession, a: argparse.Namespace) -> str | None:
    name = a.command
    g = from_text(spark, Path(a.input).read_text() if a.input else sys.stdin.read())
    if name == "build":
        return _out(a.output, documents.graph_json(g if g.communities is not None else Graph(g.nodes, g.edges, spark.createDataFrame([], "cid long, node_id string"))))
    if name == "validate":
        return json.dumps(_json(normalize.validate(g.nodes, g.edges.withColumn("ord", F.col("spos")))), indent=2)
    g = _clustered(g)
    if name == "cluster":
        return json.dumps({str(r["cid"]): sorted(r["ids"]) for r in g.communities.groupBy("cid").agg(F.collect_list("node_id").alias("ids")).orderBy("cid").collect()})
    if name == "analyze":
        return json.dumps({k: _json(v) for k, v in pipeline.analysis(g).items()}, indent=2, ensure_ascii=False)
    if name == "report":
        return _out(a.output, [reports.report(g)])
    if name in ("export-vault", "export-wiki"):
        n = (documents.vault if name == "export-vault" else documents.wiki)(g, a.output or name.removeprefix("export-"))
        return f"{n} files"
    if name == "export-push":
        return f"{documents.push(g, _sender(a.url))} statements"
    makers = {
        "export-json": lambda: documents.graph_json(g), "export-cypher": lambda: documents.cypher(g), "export-graphml": lambda: documents.graphml(g), "export-html": lambda: [reports.page(g)],
        "export-html-3d": lambda: [reports.page_3d(g)], "export-svg": lambda: documents.svg(g), "export-canvas": lambda: [documents.canvas(g)],
    }
    return _out(a.output, makers[name]())


def _sender(url: str):
    """Sends statements to a graph database's transaction address as one request a batch."""

    def send(statements: list[str]) -> None:
        import urllib.request

        body = json.dumps({"statements": [{"statement": s} for s in statements]}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=60) as r:
            failed = json.loads(r.read()).get("errors")
        if failed:
            raise RuntimeError(str(failed[0]))

    return send


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    own = spark is None
    spark = spark or session("cli", spark__sql__shuffle__partitions="8")
    try:
        text = answer(spark, a)
        if text is not None:
            print(text)
        return 0
    except (LookupError, ValueError, NotImplementedError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
