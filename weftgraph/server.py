"""Questions over standard input and output: one JSON-RPC request a line, one answer a line."""

from __future__ import annotations

import json
import sys
from typing import IO, Any

from weftgraph.graph import Graph
from weftgraph.operators import query

_TEXT, _INT = {"type": "string"}, {"type": "integer"}
TOOLS: dict[str, tuple[str, dict[str, dict], list[str]]] = {
    "query_graph": ("Search the graph and walk from the best hits.", {"question": _TEXT, "mode": _TEXT, "depth": _INT, "token_budget": _INT}, ["question"]),
    "get_node": ("Describe a node.", {"label": _TEXT}, ["label"]),
    "get_neighbors": ("List a node's neighbours.", {"label": _TEXT, "relation_filter": _TEXT}, ["label"]),
    "get_community": ("List a community's members.", {"community_id": _INT}, ["community_id"]),
    "god_nodes": ("List the best connected nodes.", {"top_n": _INT}, []),
    "graph_stats": ("Count nodes, edges and communities.", {}, []),
    "shortest_path": ("Find a shortest path.", {"source": _TEXT, "target": _TEXT, "max_hops": _INT}, ["source", "target"]),
}


class BadParams(ValueError):
    pass


def call(g: Graph, tool: str, args: dict[str, Any]) -> str:
    """The text of a tool; integers may come as digits."""
    if tool not in TOOLS:
        raise BadParams(f"unknown tool {tool}")
    _, kinds, needed = TOOLS[tool]
    for k in needed:
        if args.get(k) in (None, ""):
            raise BadParams(f"missing {k}")
    try:
        a = {k: int(v) if kinds[k] is _INT else str(v) for k, v in args.items() if k in kinds and v is not None}
    except (TypeError, ValueError) as e:
        raise BadParams(str(e)) from e
    if tool == "query_graph":
        return query.ask(g, a["question"], min(a.get("depth", 3), 6), a.get("token_budget", 2000), a.get("mode") == "dfs")
    if tool == "get_node":
        return query.explain(g, a["label"])
    if tool == "get_neighbors":
        return query.neighbors(g, a["label"], a.get("relation_filter"))
    if tool == "get_community":
        return query.community(g, a["community_id"])
    if tool == "god_nodes":
        return query.god_nodes(g, a.get("top_n", 10))
    if tool == "graph_stats":
        return query.stats(g)
    return query.path_text(g, a["source"], a["target"], a.get("max_hops"))


def answer(g: Graph, request: dict[str, Any]) -> dict[str, Any] | None:
    """The answer to a request; None for a notification."""
    if "id" not in request:
        return None
    base = {"jsonrpc": "2.0", "id": request["id"]}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return base | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "weftgraph", "version": "0.1"}}}
    if method == "ping":
        return base | {"result": {}}
    if method == "tools/list":
        return base | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}}
    if method != "tools/call":
        return base | {"error": {"code": -32601, "message": f"unknown method {method}"}}
    try:
        text, bad = call(g, params.get("name", ""), params.get("arguments") or {}), False
    except BadParams as e:
        return base | {"error": {"code": -32602, "message": str(e)}}
    except LookupError as e:
        text, bad = str(e.args[0]), True
    return base | {"result": {"content": [{"type": "text", "text": text}], "isError": bad}}


def serve(g: Graph, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
    """Answers until the input ends; lines that are no JSON objects are passed over.  The graph is kept between requests."""
    for df in (g.nodes, g.edges, g.communities):
        df.persist()
    for line in lines:
        try:
            request = json.loads(line)
        except ValueError:
            continue
        reply = answer(g, request) if isinstance(request, dict) else None
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
