"""Operators on small literal graphs."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import analyze, centrality, cluster, export, layout, metrics, normalize, query, report, traverse
from weftgraph.sources.graphs import from_rows, model_reply, read_json, read_parquet, write_parquet


def edges(*pairs, **more):
    return [{"source": a, "target": b, **more} for a, b in pairs]


def graph(spark, text, comm=None, nodes=(), **more):
    """A graph of links like `a-b b-c`."""
    pairs = [p.split("-") for p in text.split()]
    ids = sorted({x for p in pairs for x in p} | set(nodes))
    g = from_rows(spark, [{"id": i, "label": i.upper(), "source_file": f"src/{i}.py"} for i in ids], edges(*pairs, **more), comm)
    return Graph(*(df.coalesce(1).cache() for df in (g.nodes, g.edges, g.communities)))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_last_payload_at_first_position(spark):
    g = from_rows(spark, [{"id": "n1", "label": "old"}, {"id": "n2"}, {"id": "n1", "label": "new"}], [])
    assert [(r["id"], r["label"]) for r in g.nodes.orderBy("ord").collect()] == [("n1", "new"), ("n2", "n2")]


def test_dangling_edges_go_and_ends_may_be_named_from_and_to(spark):
    g = from_rows(spark, [{"id": "a"}, {"id": "b"}], [{"from": "a", "to": "b"}, {"source": "a", "target": "gone"}])
    assert rows(g.edges, "source", "target", "weight") == [("a", "b", 1.0)]


def test_drifted_ids_resolve_by_slug(spark):
    g = from_rows(spark, [{"id": "src_main_py"}, {"id": "b"}], edges(("Src.Main py", "b")))
    assert rows(g.edges, "source", "target", "src0") == [("src_main_py", "b", "Src.Main py")]


def test_one_edge_for_a_pair_the_last_wins(spark):
    g = from_rows(spark, [{"id": "b"}, {"id": "a"}], [{"source": "a", "target": "b", "relation": "calls"}, {"source": "b", "target": "a", "relation": "uses", "weight": 3}])
    assert rows(g.edges, "source", "target", "relation", "weight") == [("b", "a", "uses", 3.0)]


def test_loops_count_two_one_and_none(spark):
    g = from_rows(spark, [{"id": "n1"}, {"id": "n5"}], edges(("n1", "n1")))
    r = metrics.degree_variants(g).collect()
    assert [(x["degree"], x["neighbours"], x["proper"]) for x in r] == [(2, 1, 0)]
    assert rows(traverse.ball(g, g.nodes.filter("id = 'n5'"), 2), "id") == [("n5",)]


def test_chain_has_its_middle_as_god(spark):
    g = graph(spark, "a-b b-c")
    assert [(r["id"], r["degree"]) for r in metrics.god_nodes(g, 1).collect()] == [("b", 2)]


def test_cohesion(spark):
    g = graph(spark, "a-b b-c a-c", {0: ["a", "b", "c"], 1: ["d"], 2: ["e", "f"]}, nodes="def")
    assert rows(metrics.cohesion(g), "cid", "cohesion") == [(0, 1.0), (1, 1.0), (2, 0.0)]


def test_search_folds_accents_and_prefers_labels(spark):
    g = from_rows(spark, [{"id": "n1", "label": "Café Señor"}, {"id": "n2", "label": "x", "source_file": "cafe/y.py"}], [])
    assert [(r["id"], r["score"]) for r in traverse.starts(g, traverse.terms("CAFÉ"), 5).orderBy("rank").collect()] == [("n1", 2), ("n2", 1)]


def test_ball_depth_and_parents(spark):
    g = graph(spark, "a-b b-c c-d a-e e-c")
    start = g.nodes.filter("id = 'a'")
    assert rows(traverse.ball(g, start, 1), "id") == [("a",), ("b",), ("e",)]
    assert [(r["id"], r["level"], r["parent"]) for r in traverse.ball(g, start, 3).orderBy("level", "id").collect()] == [("a", 0, None), ("b", 1, "a"), ("e", 1, "a"), ("c", 2, "b"), ("d", 3, "c")]


def test_depth_first_walk_against_a_stack(spark):
    g = graph(spark, "a-b a-c b-d c-d d-e e-f")
    near = {}
    for r in g.adjacency.collect():
        near.setdefault(r["id"], []).append(r["other"])
    for depth in (1, 2, 3):
        seen, stack = [], [("a", 0)]
        while stack:
            x, d = stack.pop()
            if x in seen or d > depth:
                continue
            seen.append(x)
            stack += [(y, d + 1) for y in sorted(near[x]) if y not in seen]
        assert [r["id"] for r in traverse.dfs(g, ["a"], depth).orderBy("at").collect()] == seen


def test_paths(spark):
    g = graph(spark, "a-b b-c c-d a-e", nodes="z")
    assert traverse.path(g, "e", "d") == ["e", "a", "b", "c", "d"]
    assert traverse.path(g, "a", "z") is None
    assert query.path_text(g, "E", "C") == "Shortest path (3 hops):\n  E --uses [EXTRACTED]--> A --uses [EXTRACTED]--> B --uses [EXTRACTED]--> C"
    assert query.path_text(g, "E", "C", 1) == "Path exceeds max_hops=1 (3 hops found)."
    with pytest.raises(LookupError):
        query.path_text(g, "nobody", "C")


def brandes(n, links):
    """Counts over all shortest paths, listed one by one."""
    near = [[] for _ in range(n)]
    for a, b in links:
        near[a].append(b)
        near[b].append(a)
    node, edge = np.zeros(n), {}
    for s, t in itertools.combinations(range(n), 2):
        paths, level = [[s]], 0
        while paths and not any(p[-1] == t for p in paths) and level < n:
            paths = [p + [y] for p in paths for y in near[p[-1]] if y not in p]
            level += 1
        paths = [p for p in paths if p[-1] == t]
        for p in paths:
            for x in p[1:-1]:
                node[x] += 1 / len(paths)
            for x, y in zip(p, p[1:]):
                k = (min(x, y), max(x, y))
                edge[k] = edge.get(k, 0) + 1 / len(paths)
    return node * 2 / ((n - 1) * (n - 2)), {k: v * 2 / (n * (n - 1)) for k, v in edge.items()}


def test_betweenness_against_listing_paths_in_both_ways(spark):
    links = [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5), (2, 5), (6, 7)]
    g = graph(spark, " ".join(f"{a}-{b}" for a, b in links))
    node, edge = brandes(8, links)
    for most in (10**6, 0):
        got = {r["id"]: r["score"] for r in centrality.node_betweenness(g, most_ends=most).collect()}
        assert [got[str(i)] for i in range(8)] == pytest.approx(node.tolist())
    got = {(int(r["source"]), int(r["target"])): r["score"] for r in centrality.edge_betweenness(g).collect()}
    assert got == pytest.approx(edge)


def test_sample_positions():
    assert centrality.sample_positions(10, 3) == [1, 5, 8]
    assert centrality.sample_positions(3, 5) == [0, 1, 2]


@pytest.mark.parametrize("most", [10**6, 6])
def test_two_triangles_are_two_communities(spark, most):
    g = graph(spark, "a-b b-c a-c x-y y-z x-z c-x", nodes="q")
    c = {}
    for r in cluster.communities(g, most).collect():
        c.setdefault(r["cid"], set()).add(r["node_id"])
    if most > 6:
        assert c == {0: {"a", "b", "c"}, 1: {"x", "y", "z"}, 2: {"q"}}
    assert sorted(x for m in c.values() for x in m) == list("abcqxyz")
    assert [len(c[k]) for k in sorted(c)] == sorted((len(m) for m in c.values()), reverse=True)


def test_no_edges_and_zero_weights_give_singletons(spark):
    g = from_rows(spark, [{"id": i} for i in "cab"], [])
    assert rows(cluster.communities(g), "cid", "node_id") == [(0, "a"), (1, "b"), (2, "c")]
    g = from_rows(spark, [{"id": i} for i in "ab"], edges(("a", "b"), weight=0))
    assert rows(cluster.communities(g), "cid", "node_id") == [(0, "a"), (1, "b")]


def test_equal_sizes_go_by_smallest_member(spark):
    g = graph(spark, "y-z a-b")
    assert rows(cluster.communities(g), "cid", "node_id") == [(0, "a"), (0, "b"), (1, "y"), (1, "z")]


def test_surprises_need_other_files_and_add_up(spark):
    n = [{"id": "p", "label": "P", "source_file": "a/x.py"}, {"id": "q", "label": "Q", "source_file": "b/y.pdf"}, {"id": "r", "label": "R", "source_file": "a/z.py"}]
    g = from_rows(spark, n, [{"source": "q", "target": "p", "confidence": "AMBIGUOUS", "relation": "semantically_similar_to"}, {"source": "p", "target": "r"}, {"source": "q", "target": "r", "relation": "contains"}], {0: ["p", "r"], 1: ["q"]})
    r = analyze.surprises(g).orderBy("rank").collect()
    assert [(x["source"], x["target"], x["score"]) for x in r] == [("Q", "P", 12), ("P", "R", 1)]
    assert r[0]["why"].startswith("ambiguous connection") and r[1]["why"] == "cross-file semantic connection"


def test_bridge_question_names_the_bridge(spark):
    g = graph(spark, "a-b b-c c-d d-e", {0: ["a", "b", "c"], 1: ["d", "e"]})
    q = analyze.bridge_questions(g).collect()
    assert {r["question"] for r in q} >= {"Why does `C` connect `Community 0` to `Community 1`?"}


def test_no_signal(spark):
    g = graph(spark, "a-b b-c a-c", {0: ["a", "b", "c"]})
    assert [r["type"] for r in analyze.questions(g).collect()] == ["no_signal"]


def test_diff_and_summary(spark):
    a, b = graph(spark, "a-b b-c"), graph(spark, "a-b b-d")
    n, e = normalize.diff((a.nodes, a.edges), (b.nodes, b.edges))
    assert rows(n, "change", "id") == [("new", "d"), ("removed", "c")]
    assert normalize.diff_summary(n, e).head()["summary"] == "1 new node, 1 new edge, 1 node removed, 1 edge removed"
    same = normalize.diff((a.nodes, a.edges), (a.nodes, a.edges))
    assert normalize.diff_summary(*same).head()["summary"] == "no changes"


def test_labels_merge_but_not_those_without_letters(spark):
    n = [{"id": "foo_chunk1", "label": "Foo"}, {"id": "foo_longer", "label": "foo!"}, {"id": "foo", "label": "FOO"}, {"id": "k1", "label": "漢"}, {"id": "k2", "label": "字"}]
    g = from_rows(spark, n, edges(("foo_longer", "k1"), ("foo", "foo_chunk1")))
    nodes, moved = normalize.merge_labels(g.nodes, g.edges)
    assert rows(nodes, "id") == [("foo",), ("k1",), ("k2",)]
    assert rows(moved, "source", "target") == [("foo", "k1")]


def test_union_needs_two_and_the_first_wins(spark):
    a, b = graph(spark, "a-b"), graph(spark, "b-c")
    n, e = normalize.union_graphs([("east", a.nodes, a.edges), ("west", b.nodes, b.edges)])
    assert rows(n, "id", "repo") == [("a", "east"), ("b", "east"), ("c", "west")]
    assert e.count() == 2
    with pytest.raises(ValueError):
        normalize.union_graphs([("east", a.nodes, a.edges)])


def test_texts_of_questions(spark):
    g = graph(spark, "alpha-beta beta-gamma", {0: ["alpha", "beta"], 1: ["gamma"]})
    assert query.ask(g, "alpha?", 1) == "No matching nodes found."
    text = query.ask(g, "alpha", 1)
    assert text.splitlines()[0] == "NODE BETA [src=src/beta.py loc= community=0]"
    assert text.splitlines()[-1] == "EDGE ALPHA --uses [EXTRACTED]--> BETA"
    assert "truncated to ~5 token budget" in query.ask(g, "alpha", 1, 5)
    assert "Degree:    2" in query.explain(g, "beta") and "Connections (2):" in query.explain(g, "beta")
    assert query.neighbors(g, "beta").count("-->") == 2
    assert query.community(g, 0).startswith("Community 0 (2 nodes)")
    assert query.stats(g).startswith("Nodes: 3\nEdges: 2\nCommunities: 2\nEXTRACTED: 100%")
    assert query.god_nodes(g, 1).endswith("BETA - 2 edges")


def test_report_page_and_layout(spark):
    g = graph(spark, "a-b b-c x-y", {0: ["a", "b", "c"], 1: ["x", "y"]})
    text = report.report(g)
    assert "## Hyperedges" not in text and "## Suggested Questions" in text
    hyper = spark.createDataFrame([("h", ["a", "b"])], "label string, nodes array<string>")
    assert "## Hyperedges" in report.report(g, hyperedges=hyper)
    assert '"nodes"' in report.page(g) and "Community 0" in report.overview_page(g)
    with pytest.raises(ValueError):
        report.page(g, 2)
    at = layout.layout(g).collect()
    assert len(at) == 5 and all(np.isfinite([r["x"], r["y"], r["z"]]).all() for r in at)


def test_notes_of_a_vault(spark):
    g = graph(spark, "a-b", {0: ["a"]})
    notes = {r["name"]: r["content"] for r in export.vault_notes(g).collect()}
    assert "- [[B]] - `uses` [EXTRACTED]" in notes["A"] and "Community None" in notes["B"]
    n = from_rows(spark, [{"id": "1", "label": "x.md"}, {"id": "2", "label": "x"}, {"id": "3", "label": "???"}], []).nodes
    assert rows(export.vault_names(n), "id", "name") == [("1", "x"), ("2", "x_1"), ("3", "unnamed")]


def test_json_and_parquet_round_trip(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes":[{"id":"a","label":"A","community":3},{"id":"b","label":"B"},{"label":"lost"}],"links":[{"from":"a","to":"b","relation":"uses","confidence":"INFERRED"},{"source":"a"}]}')
    g = read_json(spark, str(tmp_path / "g.json"))
    assert rows(g.nodes, "id", "label") == [("a", "A"), ("b", "B")]
    assert rows(g.edges, "source", "target", "weight") == [("a", "b", 1.0)]
    write_parquet(g, str(tmp_path / "p"))
    h = read_parquet(spark, str(tmp_path / "p"))
    assert rows(h.edges, "source", "target", "confidence") == [("a", "b", "INFERRED")]
    assert rows(h.communities, "cid", "node_id") == [(3, "a")]


def test_replies_of_models():
    r = model_reply('```json\n{"nodes":[{"id":"a"}],"edges":[{"source":"a","target":"b"}]}\n```')
    assert r["nodes"][0]["node_type"] == "concept" and r["edges"][0]["confidence_score"] == 0.7
    assert model_reply("no json") == {"nodes": [], "edges": []}


def test_preserved_semantics(spark):
    n = [{"id": "c"}, {"id": "d", "file_type": "document"}, {"id": "e", "file_type": "rationale"}]
    g = from_rows(spark, n, [{"source": "c", "target": "d"}, {"source": "d", "target": "e"}, {"source": "c", "target": "e", "confidence": "AMBIGUOUS"}])
    nodes, kept = normalize.preserved_semantics(g.nodes, g.edges)
    assert rows(nodes, "id") == [("d",), ("e",)]
    assert rows(kept, "source", "target") == [("c", "e"), ("d", "e")]


def test_empty_graph_has_a_result_everywhere(spark):
    g = from_rows(spark, [], [])
    assert metrics.stats(g).head()["edges"] == 0
    for df in (metrics.god_nodes(g), metrics.cohesion(g), analyze.surprises(g), analyze.isolated_questions(g), cluster.communities(g), export.canvas_grid(g), centrality.node_betweenness(g)):
        assert df.count() == 0


def test_plan_of_degree_has_one_exchange(spark):
    g = Graph(spark.createDataFrame([("a", "a", "code", "a.py", 0)], "id string, label string, file_type string, source_file string, ord long"), spark.createDataFrame([("a", "b")], "source string, target string"))
    plan = g.degree._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan


def test_plan_of_neighbours_filters_before_the_join(spark, small):
    from weftgraph.sources.derived import graph as derived

    g = derived(spark, small)
    plan = g.nodes.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" not in plan and F is not None
