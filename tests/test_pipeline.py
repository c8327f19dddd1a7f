"""Code extraction, bundles, documents, the command line, watching, notes and guards, on small folders."""

from __future__ import annotations

import json
import os
import xml.etree.ElementTree as ET

import pytest

from weftgraph import cli, pipeline
from weftgraph.operators import cluster, documents, report
from weftgraph.sources import cache, extract, files, graphs, guards, ingest
from weftgraph.streaming import watch


def code(spark, *sources):
    n, e = extract.code_graph(extract.extract(spark.createDataFrame(list(sources), "path string, text string")))
    return {r["id"]: r for r in n.collect()}, {(r["source"], r["relation"], r["target"]): r["confidence"] for r in e.collect()}


def test_python_files_together(spark):
    auth = '"""Handlers describe how requests use the shared models."""\nfrom models import Response\nimport a.b as c\nfrom ..up import X\nfrom . import y\n\nclass DigestAuth(Auth):\n    def build(self):\n        return Response()\n\nclass Handler(urllib.request.Redirect):\n    pass\n\nclass Child(DigestAuth):\n    pass\n'
    n, e = code(spark, ("pkg/sub/auth.py", auth), ("models.py", "class Response:\n    pass\n"))
    assert e["auth_digestauth", "inherits", "auth"] == "EXTRACTED" and n["auth"]["source_file"] == "" and n["auth"]["label"] == "Auth"
    assert ("auth_child", "inherits", "auth_digestauth") in e and not any(r == "inherits" and a == "auth_handler" for a, r, _ in e)
    assert e["auth_digestauth", "uses", "models_response"] == "INFERRED" and ("auth_rationale_1", "uses", "models_response") in e
    assert e["auth_digestauth_build", "calls", "models_response"] == "INFERRED"
    assert {t for s, r, t in e if s == "pkg_sub_auth_py" and r.startswith("imports")} == {"models", "a_b", "pkg_up_py", "pkg_sub_init_py"}


def test_receivers_and_placeholders_over_files(spark):
    lib = "pub struct Client;\nimpl Client {\n    pub fn send(&self) {}\n}\n"
    use = "fn make() -> Client {\n}\nfn go() {\n    make().send();\n}\n"
    n, e = code(spark, ("lib.rs", lib), ("use.rs", use), ("other.rs", "struct Wire;\nimpl Wire {\n    fn send(&self) {}\n}\n"))
    assert e["use_go", "calls", "other_wire_send"] == "INFERRED"  # a name known by label goes before receivers; the last label counts
    rows = extract.extract(spark.createDataFrame([("use.rs", use), ("m.py", "def f() -> a.Reply:\n    pass\n"), ("t.ts", "function go(): Promise<Foo> {\n}\n")], "path string, text string"))
    assert {(r["name"], r["module"]) for r in rows.filter("part = 'return'").collect()} == {("make", "Client"), ("f", "Reply"), ("go", "Foo")}
    n, e = code(spark, ("a.py", "class A(Base): pass\n"), ("b.py", "class B(Base): pass\n"), ("base.py", "x = 1\n"))
    assert sum(r["label"] == "Base" for r in n.values()) == 1


def test_other_languages(spark):
    php = "<?php\nclass Config {\n    const VERSION = '1.0';\n}\nclass App {\n    public function boot() {\n        return Config::VERSION;\n    }\n    public function go() {\n        $x = Config::$y;\n        $this->app->bind(App::class, Config::class);\n    }\n    protected $listen = [App::class => [Config::class]];\n}\n"
    objc = '#import "Base.h"\n@interface View : Base <Drawable>\n- (void)draw;\n@end\n@implementation View\n- (void)draw {\n [self paint];\n}\n- (int)paint {\n return 1;\n}\n@end\n'
    ts = "import {a} from './x/../b.js';\nimport q from '../c.jsx';\nimport c from 'lib/deep';\nclass Foo extends Bar {\n}\n"
    swift = "enum Color {\n    case red, green\n    deinit {\n    }\n}\nextension Color {\n    func paint() {\n    }\n}\n"
    go = "package pk\nfunc (s *Srv) Run() {\n}\n"
    n, e = code(spark, ("s.php", php), ("v.m", objc), ("src/main.ts", ts), ("c.swift", swift), ("pk/a.go", go), ("pk/b.go", "package pk\ntype Srv struct {\n}\n"), ("k.kt", "fun a() {\n    b()\n}\nfun b() {\n}\n"))
    assert {("s_app_boot", "references_constant", "s_config"), ("s_app_go", "uses_static_prop", "s_config"), ("s_app", "bound_to", "s_config"), ("s_app", "listened_by", "s_config")} <= set(e)
    assert {("v_view_draw", "calls", "v_view_paint"), ("v_view", "inherits", "base"), ("v_m", "imports", "drawable"), ("v_m", "imports", "base")} <= set(e) and n["v_view"]["node_type"] == "class"
    assert {("src_main_ts", "imports_from", "src_b_ts"), ("src_main_ts", "imports_from", "c_tsx"), ("src_main_ts", "imports_from", "deep"), ("main_foo", "inherits", "bar")} <= set(e)
    assert {("c_color", "case_of", "c_color_green"), ("c_color", "method", "c_color_paint"), ("c_color", "method", "c_color_deinit")} <= set(e)
    assert ("pk_srv", "method", "pk_srv_run") in e and "pk_srv" in n and not any(r == "calls" and a.startswith("k_") for a, r, _ in e)


@pytest.fixture
def project(tmp_path):
    (tmp_path / "auth.py").write_text("from models import Response\n\n\nclass Auth(Base):\n    def build(self):\n        return Response()\n")
    (tmp_path / "models.py").write_text("class Response:\n    pass\n")
    (tmp_path / "readme.md").write_text("# Title\n\nwords here\n")
    return tmp_path


def test_rebuild_keeps_what_is_known_and_guards(spark, project):
    b = pipeline.rebuild(spark, project)
    data = json.loads((b.folder / "graph.json").read_text())
    assert b.replaced and len(data["nodes"]) == b.nodes == 6 and {"communities", "god_nodes", "surprising_connections", "suggest_questions"} <= set(data)
    assert (b.folder / "report.md").read_text().startswith(f"# {project.name}") and (b.folder / "graph-3d.html").exists() and not (b.folder / "wiki").exists()
    # a concept that a model gave, tied to code by a reasoned edge, outlives a rebuild; a file's removal alone doesn't replace the graph
    g = graphs.read_parquet(spark, str(b.folder / "graph"))
    n = g.nodes.unionByName(spark.createDataFrame([("idea", "Idea", "document", "readme.md", "", 99)], "id string, label string, file_type string, source_file string, source_location string, ord long"), allowMissingColumns=True)
    e = g.edges.unionByName(spark.createDataFrame([("idea", "auth_auth", "describes", "INFERRED", 0.0, 1, 99)], "source string, target string, relation string, confidence string, weight double, spos long, tpos long"), allowMissingColumns=True)
    known = pipeline.merge([(n, e)])
    known.nodes.checkpoint()
    pipeline.write_bundle(graphs.Graph(known.nodes.checkpoint(), known.edges.checkpoint()), b.folder)
    pipeline.flag_update(b.folder)
    assert "pending" in pipeline.update_text(b.folder)
    again = pipeline.rebuild(spark, project, wiki=True)
    data = json.loads((b.folder / "graph.json").read_text())
    assert again.nodes == 7 and any(x["relation"] == "describes" for x in data["links"]) and (b.folder / "wiki" / "index.md").exists() and pipeline.update_text(b.folder).startswith("No")
    less = graphs.from_rows(spark, [{"id": "a"}], [])
    assert not pipeline.write_bundle(less, b.folder).replaced and len(json.loads((b.folder / "graph.json").read_text())["nodes"]) == 7


def test_cache_extracts_only_what_changed(spark, project, tmp_path_factory):
    at, seen = str(tmp_path_factory.mktemp("cache") / "rows"), []

    def count(df):
        seen.append(sorted(r["path"] for r in df.select("path").collect()))
        return extract.extract(df)

    listed = lambda: files.listing(spark, str(project)).filter("path like '%.py'")
    first = cache.through(listed(), at, count).collect()
    (project / "models.py").write_text("class Reply:\n    pass\n")
    second = cache.through(listed(), at, count).collect()
    assert seen == [["auth.py", "models.py"], ["models.py"]] and any(r["label"] == "Reply" for r in second) and not any(r["label"] == "Response" for r in second) and len(first) == len(second)
    hits, missed = cache.split(files.listing(spark, str(project)), cache.read(spark, at))
    assert hits.count() and [r["path"] for r in missed.collect()] == ["readme.md"]
    cache.clear(spark, at)
    assert cache.read(spark, at) is None


@pytest.fixture(scope="module")
def small_graph(spark):
    nodes = [{"id": f"n{i}", "label": f"Node & {i}" if i else "<b>", "source_file": f"d{i % 3}/f{i}.py"} for i in range(12)]
    edges = [{"source": f"n{i}", "target": f"n{(i * i + 1) % 12}", "relation": "calls", "confidence": ("EXTRACTED", "INFERRED", "AMBIGUOUS")[i % 3], "weight": i + 1} for i in range(12)]
    g = graphs.from_rows(spark, nodes, edges, {0: [f"n{i}" for i in range(6)], 1: [f"n{i}" for i in range(6, 12)]})
    return graphs.Graph(g.nodes.checkpoint(), g.edges.checkpoint(), g.communities.checkpoint())


def test_documents(spark, small_graph, tmp_path):
    g = small_graph
    data = json.loads("\n".join(documents.graph_json(g, {"more": [1]})))
    assert len(data["nodes"]) == 12 and len(data["links"]) == g.edges.count() and data["more"] == [1]
    root = ET.fromstring("\n".join(documents.graphml(g)).split("\n", 1)[1])
    assert len(root.findall(".//{*}node")) == 12 and len(root.findall(".//{*}key")) == 6
    drawn = ET.fromstring("\n".join(documents.svg(g)))
    assert len(drawn.findall("{*}circle")) == 12 and len(drawn.findall("{*}line")) == g.edges.count()
    box = json.loads(documents.canvas(g))
    assert sum(x["type"] == "group" for x in box["nodes"]) == 2 and sum(x["type"] == "file" for x in box["nodes"]) == 12 and len(box["edges"]) == g.edges.count()
    assert len(list(documents.cypher(g))) == 12 + g.edges.count()
    assert documents.vault(g, tmp_path / "v") == 14 and "## Bridges" in (tmp_path / "v" / "Community 0.md").read_text() and (tmp_path / "v" / ".obsidian" / "graph.json").exists()
    assert documents.wiki(g, tmp_path / "w") == len(list((tmp_path / "w").iterdir())) and "Audit Trail" in (tmp_path / "w" / "Community_1.md").read_text()
    text = report.report(g, "T")
    heads = [x[3:] for x in text.split("\n") if x.startswith("## ")]
    assert heads == ["Corpus Check", "Summary", "Community Hubs", "God Nodes", "Surprising Connections", "Communities", "Ambiguous Edges", "Knowledge Gaps", "Suggested Questions"]
    log = tmp_path / "sent"

    def send(statements):
        with open(log, "a") as f:
            f.write(f"{len(statements)}\n")

    assert documents.push(g, send, 5) == 12 + g.edges.count() and max(map(int, log.read_text().split())) <= 5


def test_overview_takes_the_place_of_a_large_page(spark, small_graph, monkeypatch):
    assert '"n3"' in report.page_3d(small_graph)
    monkeypatch.setattr(report, "LARGE_NODES", 5)
    assert '"n3"' not in report.page_3d(small_graph) and "Community 0" in report.page_3d(small_graph)


def test_command_line(spark, small_graph, project, tmp_path, capsys):
    at = tmp_path / "graph.json"
    documents.write_lines(documents.graph_json(small_graph), at)

    def run(*args, code=0):
        assert cli.main(list(args), spark) == code
        return capsys.readouterr()

    assert run("stats", "--graph", str(at)).out.startswith("Nodes: 12")
    assert "Shortest path" in run("path", "node & 4", "node & 5", "--graph", str(at)).out
    assert run("path", "zzz", "node", "--graph", str(at), code=1).err.startswith("error")
    for args in (["query", "node"], ["explain", "n3"], ["neighbors", "n3"], ["community", "1"], ["god-nodes"], ["benchmark", "--question", "node 3"]):
        assert run(*args, "--graph", str(at)).out
    assert len(json.loads(run("analyze", "--input", str(at)).out)) == 4 and set(json.loads(run("cluster", "--input", str(at)).out)) >= {"0", "1"}
    for kind in ("json", "cypher", "graphml", "html", "html-3d", "svg", "canvas"):
        run(f"export-{kind}", "--input", str(at), "--output", str(tmp_path / f"out.{kind}"))
        assert (tmp_path / f"out.{kind}").stat().st_size > 100
    for args in (["build"], ["report"], ["validate"]):
        assert run(*args, "--input", str(at)).out
    assert json.loads(run("diff", str(at), str(at)).out)["summary"] == "no changes"
    other = tmp_path / "x" / "kg-out" / "graph.json"
    documents.write_lines(documents.graph_json(small_graph), other)
    merged = json.loads(run("merge-graphs", str(at), str(other)).out)
    assert len(merged["nodes"]) == 12 and graphs.repo_tag(str(other)) == "x"
    found = json.loads(run("detect", str(project)).out)
    assert found["files"]["code"] == ["auth.py", "models.py"] and found["words"] > 0
    assert "auth.py" in json.loads(run("detect-incremental", str(project), "--manifest", str(tmp_path / "none")).out)["new"]
    assert "Rebuilt: 6 nodes" in run("update", str(project)).out and "No update" in run("check-update", str(project / "kg-out")).out
    assert any(x["id"] == "models_response" for x in json.loads(run("extract", str(project)).out)["nodes"])
    note = run("save-result", "Why, so?", "Because.", "--folder", str(tmp_path / "m"), "--node", "A").out.strip()
    assert "# Q: Why, so?" in open(note).read() and "why__so" in note


def test_answers_are_documents(tmp_path):
    p = pipeline.save_answer('Is "it"\nso?', "Yes.", tmp_path, nodes=[f"n{i}" for i in range(12)], now=0)
    text = p.read_text()
    assert p.name.startswith("query_19700101_000000_") and text.count('"n') == 10 and text.count("\n- n") == 12 and 'date: "1970-01-01T00:00:00Z"' in text


def test_watch_waits_for_quiet(spark, tmp_path):
    now, calls = [0.0], []
    (tmp_path / "a.py").write_text("1")
    script = {2: ("a.py", "22"), 3: ("b.md", "x"), 12: (".hidden.py", "x"), 14: ("a.py", "333")}

    def sleep(_):
        now[0] += 0.5
        step = round(now[0] * 2)
        if step in script:
            (tmp_path / script[step][0]).write_text(script[step][1])

    watch.poll(spark, tmp_path, lambda c: calls.append((now[0], dict(c))), seconds=3, until=lambda: now[0] >= 12, clock=lambda: now[0], sleep=sleep)
    assert calls == [(4.5, {"a.py": "code", "b.md": "document"}), (10.0, {"a.py": "code"})]
    os.remove(tmp_path / "a.py")
    assert watch.watched("kg-out/x.py") is None and watch.watched("a/.b/x.py") is None and watch.watched("x.docx") is None and watch.watched("d/x.PDF") == "paper"


def test_stream_fires_within_its_debounce(spark, tmp_path):
    rows = [("r/a.py", "2024-01-01 00:00:00", "code"), ("r/b.py", "2024-01-01 00:00:01", "code"), (None, "2024-01-01 00:00:06", None)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "path string, ts string, file_type string").selectExpr("path", "cast(ts as timestamp) ts", "file_type").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, ts timestamp, file_type string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen = []
    q = watch.watch(stream, str(tmp_path / "cp"), lambda b: seen.append("flag"), lambda b: seen.extend(r["changes"] for r in b.collect()), every=None)
    q.awaitTermination(60)
    assert seen == [2]  # the heartbeat six seconds later closed the session


def test_each_root_folder_has_its_own_quiet(spark):
    rows = [("x", "a.py", "2024-01-01 00:00:00", "code"), ("y", "b.md", "2024-01-01 00:00:01", "document"), ("x", "c.py", "2024-01-01 00:00:02", "code")]
    df = spark.createDataFrame(rows, "root string, path string, ts string, file_type string").selectExpr("root", "path", "cast(ts as timestamp) ts", "file_type")
    assert sorted((r["root"], r["changes"], r["action"]) for r in watch.debounced(df).collect()) == [("x", 2, "rebuild"), ("y", 1, "flag")]
    assert [(r["changes"], r["action"]) for r in watch.debounced(df.drop("root")).collect()] == [(3, "flag")]


def test_urls_and_paths_are_guarded(tmp_path):
    to = lambda *ips: lambda h, p: list(ips)
    assert guards.check_url("HTTPS://example.org:8080/a?b=1", to("93.184.216.34")) == ("example.org", "/a?b=1")
    for url, ips in (("ftp://example.org/x", []), ("no-scheme", []), ("http://", []), ("http://169.254.169.254/latest", []), ("http://Metadata.Google.Internal/", []), ("http://10.0.0.8/", []), ("http://[::1]/", []), ("http://user@127.0.0.1/", []), ("http://evil.example/", ["93.184.216.34", "192.168.1.1"]), ("http://x.example/", ["fd00::1"]), ("http://[::1/", [])):
        with pytest.raises(guards.Refused):
            guards.check_url(url, to(*ips))
    out = tmp_path / "kg-out"
    with pytest.raises(FileNotFoundError):
        guards.inside(out / "graph.json", out)
    out.mkdir()
    (out / "graph.json").write_text("{}")
    (tmp_path / "secret").write_text("x")
    (out / "link").symlink_to(tmp_path / "secret")
    assert guards.inside(out / "." / "graph.json", out) == (out / "graph.json").resolve()
    for bad in (out / ".." / "secret", out / "link"):
        with pytest.raises(guards.Refused):
            guards.inside(bad, out)
    with pytest.raises(FileNotFoundError):
        guards.inside(out / "none.json", out)


def test_what_is_fetched_becomes_notes(tmp_path):
    bodies = {
        "https://example.org/page": b"<title> A  page </title><script>no</script><p>Body text</p>",
        "https://export.arxiv.org/abs/2301.01234": b'<h1 class="title x">Deep Things</h1><div class="authors">A, B</div><blockquote class="abstract m">We show.</blockquote>',
        "https://example.org/f.pdf": b"%PDF",
    }
    get = lambda url, most: bodies[url] if url in bodies else b'{"html": "<p>hello</p>", "author_name": "me"}'
    add = lambda url: ingest.add_url(url, tmp_path, get=get, captured="2024-01-01T00:00:00Z", check=lambda u: ("h", "/f.pdf"))
    page, kind = add("https://example.org/page")
    assert kind == "webpage" and 'title: "A page"' in page.read_text() and "Body text" in page.read_text() and "no" not in page.read_text().split("---")[-1]
    assert add("https://example.org/page")[0].name == page.stem + "_1.md"
    paper, kind = add("https://arxiv.org/abs/2301.01234")
    assert kind == "arxiv" and paper.name == "arxiv_2301_01234.md" and "**Authors:** A, B" in paper.read_text() and "We show." in paper.read_text()
    post, kind = add("https://twitter.com/me/1")
    assert kind == "tweet" and "Tweet by @me" in post.read_text() and "hello" in post.read_text()
    assert add("https://example.org/f.pdf")[0].read_bytes() == b"%PDF"
    with pytest.raises(NotImplementedError):
        add("https://youtu.be/x")


def test_text_of_pdfs():
    import zlib

    flat = b"BT /F1 12 Tf 72 700 Td (Hello \\(there\\)) Tj T* [(W) -20 (orld) -400 (two)] TJ ET"
    packed = zlib.compress(b"BT <48692e> Tj ET")
    pdf = b"%PDF-1.4\n1 0 obj << /Length 9 >> stream\n" + flat + b"\nendstream\n2 0 obj << /Filter /FlateDecode >> stream\n" + packed + b"\nendstream\n%%EOF"
    assert files.pdf_text(pdf) == "Hello (there)\nWorld two\n\nHi." and files.pdf_text(b"no") == "" and files.pdf_text(b"%PDF broken") == ""


def test_ignore_files_up_to_the_repository(tmp_path):
    (tmp_path / ".kgignore").write_text("outer\n")
    (tmp_path / "repo" / ".git").mkdir(parents=True)
    (tmp_path / "repo" / ".kgignore").write_text("build/\n# note\n")
    (tmp_path / "repo" / "sub").mkdir()
    assert files.ignore_patterns(tmp_path / "repo" / "sub") == ["build/", "# note"]


def test_communities_of_a_bundle_cover_all(spark, small_graph):
    assert cluster.communities(small_graph).count() == 12


def test_unions_of_extractions(spark):
    h = spark.createDataFrame([("h1", ["a"])], "id string, nodes array<string>")
    t = lambda a, b: spark.createDataFrame([(a, b)], "input_tokens long, output_tokens long")
    out = pipeline.union_extractions([{"hyperedges": h, "tokens": t(1, 2)}, {"hyperedges": h.unionByName(spark.createDataFrame([("h2", ["b"])], h.schema)), "tokens": t(3, 4)}])
    assert sorted(r["id"] for r in out["hyperedges"].collect()) == ["h1", "h2"] and tuple(out["tokens"].head()) == (4, 6)
