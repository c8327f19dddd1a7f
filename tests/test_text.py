"""Column functions, sections, files, extraction, streams and the tool server."""

from __future__ import annotations

import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftgraph import server
from weftgraph.functions import text as T
from weftgraph.functions.folding import fold, fold_text
from weftgraph.operators import calls, sections
from weftgraph.sources import extract, files
from weftgraph.sources.graphs import from_rows
from weftgraph.streaming import watch


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (T.slug, ["Foo.Bar  baz", "__x__", "漢", "Ka", None], ["foo_bar_baz", "x", "", "a", None]),
    (T.note_name, ["a/b:c", "Read.MD", "  ", "x\r\ny"], ["abc", "Read", "unnamed", "x y"]),
    (T.question_slug, ["What is  it?", "???", "A" * 60], ["what_is__it", "query", "a" * 50]),
    (T.url_type, ["http://netflix.com/a", "https://arxiv.org/abs/1", "http://h/a.PDF", "http://h/a.png?x=1", "http://h/"], ["tweet", "arxiv", "pdf", "webpage", "webpage"]),
    (T.url_file_name, ["https://H.org/a b//c?", "x" * 100], ["h_org_a_b_c", "x" * 80]),
    (T.html_to_text, ["<p>a&amp;b</p><script>x<y</script> c"], ["a&amp;b c"]),
    (T.token_estimate, ["", "abcdefgh", "éé"], [1, 2, 1]),
    (T.cypher_quote, ["it's \\"], ["'it\\'s \\\\'"]),
    (T.cypher_key, ["a-b", "1x", ""], ["a_b", "_1x", "_prop"]),
    (T.call_keys, ["pkg::mod.Fn()!", "()", "a->b"], [["pkg::mod.fn", "mod.fn", "fn"], [], ["a->b", "b"]]),
    (T.file_type, ["a/b.py", "x.blade.php", "i.imageset/v.pdf", "p.pdf", "n.txt", "s.svg", "v.mp3", "none", ".env"], ["code", "code", None, "paper", "document", "image", "video", None, None]),
    (T.is_sensitive, ["src/tokenizer/a.py", "a/b.py"], [True, False]),
    (T.fenced_json, ['```json\n{"a":1}\n```'], ['{"a":1}']),
    (T.result_type, ["Result<Vec<Node>, Self>", "impl Self"], ["Node", None]),
]


@pytest.mark.parametrize("f,inputs,want", CASES, ids=[c[0].__name__ for c in CASES])
def test_columns(spark, f, inputs, want):
    assert values(spark, f, inputs) == want


def test_folding_alike_on_driver_and_columns(spark):
    x = ["Åß…Łæ", "ＡＢ　ガぱヴ", "한글", "plain", None]
    want = [None if t is None else fold_text(t) for t in x]
    assert values(spark, lambda c: fold(c, hangul=True), x) == want
    assert want[:2] == ["Ass...Lae", "AB カはウ"] and len(want[2]) == 6


def test_sections_take_their_first_body_line(spark):
    docs = spark.createDataFrame([(1, "intro\n\nmore\n# One\n\nbody\n## Two\n"), (2, "a\nb\n\nc"), (3, None), (4, " \n"), (5, "#\nx")], "doc_id long, text string")
    got = [(r["doc_id"], r["line"], r["label"], r["body"]) for r in sections.sections(docs).orderBy("doc_id", "at").collect()]
    assert got == [(1, 1, "intro more", "intro\nmore"), (1, 5, "One", "body"), (1, 7, "Two", ""), (2, 1, "a b", "a\nb"), (2, 4, "c", "c"), (5, 1, "# x", "#\nx")]


def test_scan_of_a_folder(spark, tmp_path):
    for name, body in {"src/a.py": "x = 1", "docs/b.md": "one two three", "docs/p.txt": "Abstract arXiv doi: 1", "node_modules/c.js": "x", ".hid/d.py": "x", "yarn.lock": "x", "secret.txt": "x", "skip/e.py": "x", "z.bin": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r["path"]: (r["file_type"], r["words"]) for r in files.scan(spark, str(tmp_path), ["# note", "skip/"]).collect()}
    assert got == {"src/a.py": ("code", 3), "docs/b.md": ("document", 3), "docs/p.txt": ("paper", 4)}
    s = files.summary(files.scan(spark, str(tmp_path), ["skip"])).head()
    assert s["words"] == 10 and not s["needs_graph"]


def test_office_files():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>')
    assert files.docx_text(b.getvalue()) == "# Top\n\ntext" and files.docx_text(b"no") == "" and files.xlsx_text(b"no") == ""


PY = '''import os.path
from pkg.mod import Thing


class A(Base):
    """A docstring that is long enough to count."""

    def go(self):
        helper()
        make().run()

    @property
    def size(self):
        return 1


def helper():
    # NOTE: because
    pass
'''


def test_python_extraction():
    r = extract.extract_file("pkg/m.py", PY)
    nodes = {x["id"]: x["label"] for x in r if x["part"] == "node"}
    edges = {(x["source"], x["target"], x["relation"]) for x in r if x["part"] == "edge"}
    calls_ = {(x["source"], x["callee"], x["receiver"]) for x in r if x["part"] == "call"}
    assert nodes["m_a"] == "A" and nodes["m_a_go"] == ".go()" and nodes["m_helper"] == "helper()" and nodes["pkg_m_py"] == "m.py"
    assert {("pkg_m_py", "m_a", "contains"), ("m_a", "m_a_go", "method"), ("m_a", "base", "inherits"), ("pkg_m_py", "os_path", "imports"), ("pkg_m_py", "m_a_size", "contains")} <= edges
    assert ("m_a_go", "helper", None) in calls_ and ("m_a_go", "run", "make") in calls_
    assert any(t == "m_a" and k == "rationale_for" for _, t, k in edges) and extract.extract_file("x.py", "def (")[1:] == []


@pytest.mark.parametrize("path,code,want", [
    ("a.js", "import x from './lib.js'\nclass K extends B {\n  go() {\n    help()\n  }\n}\nconst f = (a) => a\n", {"K", ".go()", "f()"}),
    ("a.go", 'import "fmt"\ntype T struct {\n}\nfunc (t T) Run() {\n  fmt.Println()\n}\n', {"T", "Run()"}),
    ("a.rs", "use std::io;\nstruct S;\nimpl S {\n    fn new() -> S { S }\n}\n", {"S", ".new()"}),
    ("A.java", "import a.b.C;\nclass A {\n    public int go(int x) {\n        return help(x);\n    }\n}\n", {"A", ".go()"}),
    ("a.rb", "class R\n  def go\n    help()\n  end\nend\n", {"R", ".go()"}),
    ("a.vue", "<template/>\n<script lang=\"ts\">\nfunction go() {}\n</script>", {"go()"}),
])
def test_other_languages(path, code, want):
    got = {x["label"] for x in extract.extract_file(path, code) if x["part"] == "node" and x["kind"] != "file"}
    assert want <= got
    assert extract.extract_file("a.txt", code) == []


def test_extraction_resolves_calls_over_files(spark):
    src = spark.createDataFrame([("a.py", "def one():\n    two()\n"), ("b.py", "def two():\n    pass\n"), ("c.py", None)], "path string, text string")
    nodes, edges, raw = extract.tables(extract.extract(src).cache())
    got = calls.resolve_calls(nodes, edges, raw)
    assert [(r["source"], r["target"], r["confidence_score"]) for r in got.collect()] == [("a_one", "b_two", 0.8)]


def test_receiver_calls_need_one_type_and_one_method(spark):
    n = spark.createDataFrame([("t", "Tool", 0), ("m", ".run()", 1), ("f", "start()", 2)], "id string, label string, ord long")
    e = spark.createDataFrame([("t", "m", "method")], "source string, target string, relation string")
    c = spark.createDataFrame([("f", "run2", "make", 1), ("f", ".go", "make", 2)], "caller string, callee string, receiver string, ord long")
    r = spark.createDataFrame([("make", "Tool")], "function_name string, return_type_name string")
    assert calls.resolve_calls(n, e, c, r).count() == 0
    c = spark.createDataFrame([("f", "nope.run", "make", 1)], "caller string, callee string, receiver string, ord long")
    assert [x["target"] for x in calls.resolve_calls(n, e, c, r).collect()] == ["m"]


def test_debounced_stream_equals_batch(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("a.py", at(0), "code"), ("b.py", at(2), "code"), ("c.md", at(10), "document"), ("d.py", at(59), "code")]
    df = spark.createDataFrame(rows, "path string, ts timestamp, file_type string")
    batch = [(r["changes"], r["action"]) for r in watch.debounced(df).orderBy("start").collect()]
    assert batch == [(2, "rebuild"), (1, "flag"), (1, "rebuild")]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = watch.debounced(stream, 3, late="5 seconds").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: seen.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted((r["changes"], r["action"]) for r in seen) == sorted(batch[:2])


def test_server(spark):
    g = from_rows(spark, [{"id": "a", "label": "Alpha"}, {"id": "b", "label": "Beta"}], [{"source": "a", "target": "b"}], {0: ["a", "b"]})
    ask = lambda m, **p: {"jsonrpc": "2.0", "id": 1, "method": m, "params": p}
    out = io.StringIO()
    lines = [ask("initialize"), ask("tools/list"), ask("tools/call", name="get_community", arguments={"community_id": "0"}), ask("tools/call", name="no"), ask("nope"), {"method": "note"}]
    server.serve(g, io.StringIO("bad\n" + "\n".join(map(json.dumps, lines))), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got) == 5 and len(got[1]["result"]["tools"]) == 7 and "Community 0 (2 nodes)" in got[2]["result"]["content"][0]["text"]
    assert got[3]["error"]["code"] == -32602 and got[4]["error"]["code"] == -32601
