"""Work that must not grow faster than its input, on small graphs and with small bounds."""

from __future__ import annotations

import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import analyze, calls, centrality, normalize, traverse
from weftgraph.plans import catalogue
from weftgraph.sources import derived
from weftgraph.sources.graphs import from_rows


def arrays(n, links):
    both = sorted({(a, b) for x, y in links for a, b in ((x, y), (y, x))})
    return np.searchsorted([a for a, _ in both], np.arange(n + 1)), np.array([b for _, b in both], np.int32)


def test_walk_looks_at_a_slice_of_the_edges_at_a_time(monkeypatch):
    """Memory follows nodes, not edges: 40 layers of 50 nodes, every two successive ones fully linked."""
    n = 2000
    links = [(50 * k + i, 50 * k + 50 + j) for k in range(39) for i in range(50) for j in range(50)]
    first, to = arrays(n, links)
    whole = centrality._walk(first, to, 0)
    monkeypatch.setattr(centrality, "SLICE", 100)
    edge = np.zeros(len(to))
    tracemalloc.start()
    sliced = centrality._walk(first, to, 0, edge)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sliced == pytest.approx(whole)
    assert edge.sum() == pytest.approx(50 * sum(range(1, 40)) + 49 * 2)  # the steps to all nodes
    assert peak < 60 * n + 100 * 200  # 195 000 directed edges


def test_codes_are_read_back_only_from_their_own_spelling(spark):
    df = spark.createDataFrame([("part_7",), ("orders_0",), ("part_07",), ("x_7",), ("part",), ("part_-1",), ("part_x",)], "id string")
    got = {r["id"]: r["back"] for r in df.select("id", derived._spelled(derived.code_of(F.col("id"))).alias("back")).collect()}
    assert got == {"part_7": "part_7", "orders_0": "orders_0", "part_07": None, "x_7": None, "part": None, "part_-1": None, "part_x": None}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joins(df):
    return sum(plan(df).count(x) for x in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "CartesianProduct"))


def test_stored_degrees_places_and_pairs_need_no_join(spark, small):
    q = catalogue.queries()
    assert joins(q["community_members"](spark, small)) == 0
    assert joins(q["wiki_articles"](spark, small)) == 0
    assert joins(q["degree_variants"](spark, small)) == 0 and "Expand" not in plan(q["degree_variants"](spark, small))


def test_both_counts_of_bridges_take_one_shuffle_of_the_edges(spark, small):
    text = plan(catalogue.queries()["community_bridges"](spark, small))
    assert text.count("Exchange hashpartitioning") == 2 and "REPARTITION_BY_COL" in text  # by key, and the few by community


def test_both_parts_of_a_diff_look_the_ends_up_together(spark, small):
    assert joins(catalogue.queries()["graph_diff_edges"](spark, small)) <= 4  # two ends, each with the flags that one join makes


def test_nodes_of_one_label_are_counted_before_they_are_shuffled(spark):
    df = spark.createDataFrame([("a_chunk", "X", 1), ("bb", "x", 2), ("c", "x!", 3), ("d", "y", 4), ("e", "?", 5), ("f", "!", 6)], "id string, label string, ord long")
    out = normalize.canonical_labels(df)
    assert "Window" not in plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [("a_chunk", "c"), ("bb", "c"), ("c", "c"), ("d", "d"), ("e", "e"), ("f", "f")]


def test_ends_are_looked_up_once_each(spark, monkeypatch):
    n = spark.createDataFrame([(1, "a", "A", "code", "f"), (2, "b", "B", "code", "f")], "ord long, id string, label string, file_type string, source_file string")
    e = spark.createDataFrame([(k, "a", t, "uses", "EXTRACTED") for k, t in enumerate(["b", "x", "x", None])] + [(9, "y", "y", "uses", "EXTRACTED")], "ord long, source string, target string, relation string, confidence string")
    for most in (10, 0):
        monkeypatch.setattr(normalize, "MOST_SENT", most)
        got = sorted((r["position"], r["error"]) for r in normalize.validate(n, e).collect())
        assert got == [(1, "target is no node"), (2, "target is no node"), (3, "missing target"), (9, "source is no node"), (9, "target is no node")]


@pytest.mark.parametrize("cell", [2, 1000])
def test_imports_meet_entities_in_cells(spark, cell):
    entities = [(f"e{i}", f"n{i % 7}", f"m{i % 3}", f"f{i % 2}", "function" if i % 5 == 0 else "class") for i in range(20)] + [("e1", "n1", "m1", "f0", "class")]
    imports = [(f"f{i % 2}", f"pkg.m{i % 3}", f"n{i % 7}", i % 4) for i in range(30)]
    names = {}
    for id, label, module, _, _ in entities:
        names[module, label] = max(names.get((module, label), ""), id)
    want = {(s, names[m.split(".")[1], n], line) for f, m, n, line in imports if (m.split(".")[1], n) in names for s, _, _, g, kind in entities if g == f and kind != "function"}
    e = spark.createDataFrame(entities, "id string, label string, module string, source_file string, kind string")
    got = calls.import_uses(e, spark.createDataFrame(imports, "source_file string, module string, name string, line int"), cell=cell).collect()
    assert len(got) == len(want) and {(r["source"], r["target"], r["line"]) for r in got} == want


@pytest.mark.parametrize("first", [1, 1000])
def test_links_between_communities_are_taken_in_order(spark, monkeypatch, first):
    """f() is a stub with one link, so its links don't count, however many are looked at first."""
    monkeypatch.setattr(analyze, "FIRST", first)
    names = "abcdef"
    n = [{"id": x, "label": "stub()" if x == "f" else x, "source_file": f"src/{x}.py"} for x in names]
    pairs = [("f", "a", "AMBIGUOUS"), ("a", "c", "INFERRED"), ("b", "c", "AMBIGUOUS"), ("a", "e", "EXTRACTED"), ("c", "e", "INFERRED"), ("c", "d", "AMBIGUOUS")]
    g = from_rows(spark, n, [{"source": a, "target": b, "relation": "uses", "confidence": c} for a, b, c in pairs], {0: ["a", "b"], 1: ["c", "d"], 2: ["e"], 3: ["f"]})
    got = [(r["rank"], r["source"], r["target"]) for r in analyze.cross_community(g, 5).orderBy("rank").collect()]
    assert got == [(1, "b", "c"), (2, "c", "e"), (3, "a", "e")]


def test_a_walk_leaves_the_edges_where_they_are(spark, small):
    g = derived.graph(spark, small)
    ball = traverse.ball(g, g.nodes.filter("id = 'nation_3'"), 1)
    text = plan(ball)
    assert "BroadcastHashJoin" in text and "LeftAnti" not in text
    assert "relation" in traverse.tree(g, g.nodes.filter("id = 'nation_3'"), 1).columns


def test_paths_from_both_ends_are_those_from_one(spark):
    links = [(a, b) for a, b in itertools.combinations(range(14), 2) if (a * 7 + b * 5) % 11 < 2] + [(14, 15)]
    name = lambda x: f"n{x:02d}"
    g = from_rows(spark, [{"id": name(x)} for x in range(16)], [{"source": name(a), "target": name(b)} for a, b in links])
    near = {name(x): sorted({name(b if a == x else a) for a, b in links if x in (a, b)}) for x in range(16)}
    for start, end in (("n00", "n13"), ("n13", "n02"), ("n05", "n12"), ("n00", "n15")):
        at, front, k = {start: 0}, [start], 0
        while front:
            k += 1
            front = sorted({y for x in front for y in near[x]} - set(at))
            at |= dict.fromkeys(front, k)
        want = None
        if end in at:
            want = [end]
            while at[want[-1]]:
                want.append(min(y for y in near[want[-1]] if at.get(y) == at[want[-1]] - 1))
            want = want[::-1]
        assert traverse.path(g, start, end) == want
