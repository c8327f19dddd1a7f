"""Code as a graph: one pass over files gives nodes, edges, unresolved calls, imports and return types as rows.

Python is parsed by its own grammar.  Other languages are read by declarations:
a table of patterns for each, with blocks followed by braces, indentation or
`end`.  Nothing here keeps state between files, so files spread over tasks; what
needs several files (calls, imports by name, receivers) is joined afterwards by
code_graph.

A base class is looked for in its file, by the file's own id, then by the bare
name; one that isn't there gets a node without a source file.
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.calls import calls_in_files, import_uses, resolve_calls
from weftgraph.operators.normalize import merge_nodes
from weftgraph.operators.ordering import number_rows

SCHEMA = "part string, id string, label string, kind string, source string, target string, relation string, callee string, receiver string, module string, name string, path string, line int, pos int, docstring string"


def slug(x: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", x).strip("_").lower()


@dataclass
class Rows:
    path: str
    out: list[dict] = field(default_factory=list)
    bases: list[tuple[str, str, int]] = field(default_factory=list)

    @property
    def stem(self) -> str:
        return self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]

    @property
    def file_id(self) -> str:
        return slug(self.path)

    def node(self, id_: str, label: str, kind: str, line: int, doc: str | None = None) -> str:
        self.out.append({"part": "node", "id": id_, "label": label, "kind": kind, "path": self.path, "line": line, "docstring": doc})
        return id_

    def edge(self, a: str, b: str, relation: str, line: int) -> None:
        self.out.append({"part": "edge", "source": a, "target": b, "relation": relation, "path": self.path, "line": line})

    def call(self, caller: str, callee: str, line: int, receiver: str | None = None) -> None:
        self.out.append({"part": "call", "source": caller, "callee": callee, "receiver": receiver, "path": self.path, "line": line})

    def brings(self, module: str, name: str | None, relation: str, line: int, target: str | None = None) -> None:
        self.out.append({"part": "import", "module": module, "name": name, "path": self.path, "line": line})
        self.edge(self.file_id, slug(target or module), relation, line)

    def inherits(self, me: str, base: str, line: int) -> None:
        self.bases.append((me, base, line))

    def gives(self, function: str, type_: str | None, line: int) -> None:
        if type_:
            self.out.append({"part": "return", "name": function, "module": type_, "path": self.path, "line": line})

    def close(self) -> list[dict]:
        """All rows, bases found or given nodes of their own, each with its place in the file."""
        known = {x["id"] for x in self.out if x["part"] == "node"}
        for me, base, line in self.bases:
            found = next((i for i in (slug(f"{self.stem}_{base}"), slug(base)) if i in known), None)
            if found is None:
                found = self.node(slug(base), base, "placeholder", line)
                known.add(found)
            self.edge(me, found, "inherits", line)
        seen: set[tuple] = set()
        out = []
        for x in self.out:
            key = (x["source"], x["target"], x["relation"]) if x["part"] == "edge" else None
            if key is None or key not in seen:
                seen.add(key)
                out.append({**x, "pos": len(out)})
        return out


def _relative(path: str, s: ast.ImportFrom) -> str:
    """The file that a relative import means: one folder up for each dot after the first."""
    base = posixpath.dirname(path)
    for _ in range(s.level - 1):
        base = posixpath.dirname(base)
    return posixpath.join(base, s.module.replace(".", "/") + ".py" if s.module else "__init__.py")


def _annotation(e: ast.expr | None) -> str | None:
    """The name of a return type: the class itself, its name if quoted, the last part if dotted."""
    if isinstance(e, ast.Constant) and isinstance(e.value, str):
        return e.value.rsplit(".", 1)[-1] if re.fullmatch(r"[\w.]+", e.value) else None
    return e.id if isinstance(e, ast.Name) else e.attr if isinstance(e, ast.Attribute) else None


_RATIONALE = re.compile(r"^\s*#\s*((?:NOTE|IMPORTANT|HACK|WHY|RATIONALE|TODO|FIXME):.*)$")


def python(r: Rows, text: str) -> None:
    """Classes, functions, methods, calls, bases, imports, and the reasons that docstrings and marked comments give."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return

    def reason(owner: str, doc: str | None, line: int) -> None:
        if doc and len(doc) > 20:
            label = re.sub(r"\s+", " ", doc)[:80]
            r.edge(r.node(slug(f"{r.stem}_rationale_{line}"), label, "rationale", line), owner, "rationale_for", line)

    def name_of(f: ast.expr) -> tuple[str, str | None]:
        if isinstance(f, ast.Attribute):
            inner = f.value
            return f.attr, name_of(inner.func)[0] if isinstance(inner, ast.Call) else None
        return (f.id, None) if isinstance(f, ast.Name) else ("", None)

    def walk(body: list[ast.stmt], owner: str, scope: str, cls: bool) -> None:
        for s in body:
            if isinstance(s, ast.ClassDef):
                me = r.node(slug(f"{scope}_{s.name}"), s.name, "class", s.lineno, ast.get_docstring(s))
                r.edge(owner, me, "contains", s.lineno)
                reason(me, ast.get_docstring(s), s.lineno)
                for b in s.bases:
                    if isinstance(b, ast.Name):  # a dotted one belongs to a module that isn't read
                        r.inherits(me, b.id, s.lineno)
                walk(s.body, me, f"{scope}_{s.name}", True)
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                prop = any(isinstance(d, ast.Name) and d.id == "property" for d in s.decorator_list)
                me = r.node(slug(f"{scope}_{s.name}"), f".{s.name}()" if cls and not prop else f"{s.name}()", "function", s.lineno, ast.get_docstring(s))
                r.edge(r.file_id if prop else owner, me, "method" if cls and not prop else "contains", s.lineno)
                reason(me, ast.get_docstring(s), s.lineno)
                r.gives(s.name, _annotation(s.returns), s.lineno)
                inner = [x for x in s.body if isinstance(x, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))]
                for x in s.body:
                    if x not in inner:
                        calls(x, me)
                walk(inner, me, f"{scope}_{s.name}", False)
            elif isinstance(s, ast.Import):
                for a in s.names:
                    r.brings(a.name, None, "imports", s.lineno)
            elif isinstance(s, ast.ImportFrom):
                for a in s.names:
                    r.brings(s.module or a.name, a.name, "imports_from", s.lineno, _relative(r.path, s) if s.level else s.module)
            else:
                for x in ast.iter_child_nodes(s):
                    if isinstance(x, ast.stmt):
                        walk([x], owner, scope, cls)

    def calls(node: ast.AST, owner: str) -> None:
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                name, receiver = name_of(x.func)
                if name:
                    r.call(owner, name, x.lineno, receiver)

    reason(r.file_id, ast.get_docstring(tree), 1)
    walk(tree.body, r.file_id, r.stem, False)
    for no, line in enumerate(text.splitlines(), 1):
        m = _RATIONALE.match(line)
        if m:
            r.edge(r.node(slug(f"{r.stem}_rationale_{no}"), m[1][:80], "rationale", no), r.file_id, "rationale_for", no)


_I = r"([A-Za-z_$][\w$]*)"
_BRACES = {"type": rf"\b(class|interface|enum|struct|trait|record|object|union|protocol|extension|actor)\s+{_I}", "function": rf"\b(?:fun|func|function|def|fn)\s+(?:\([^)]*\)\s*)?(?:<[^>]*>\s*)?{_I}\s*[(<]", "import": r"^\s*(?:import|using|use)\s+(?:static\s+|type\s+)?([\w.:*\\/]+)"}
_C = {**_BRACES, "function": rf"^\s*(?!return|else|if|for|while|switch|throw|new\b)(?:[\w:<>,*&\[\]@]+\s+)+[*&]*(?:\w+::)?{_I}\s*\([^;{{]*\)[^;{{]*\{{", "import": r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"}
_JS = {**_BRACES, "type": rf"\b(class|interface|enum|type)\s+{_I}", "function": rf"(?:\bfunction\s*\*?\s*{_I}\s*\(|\b(?:const|let|var)\s+{_I}\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>|^\s+(?:async\s+|static\s+)*(?!if|for|while|switch|catch|return){_I}\s*\([^)]*\)\s*\{{)", "import": r"""(?:from|require\(|import)\s*['"]([^'"]+)['"]"""}
LANGUAGES: dict[str, dict[str, str]] = {
    **dict.fromkeys("js jsx mjs ts tsx vue svelte".split(), _JS),
    **dict.fromkeys("c h cc cpp cxx hpp".split(), _C),
    **dict.fromkeys(["m", "mm"], {"type": rf"^\s*@(interface|implementation|protocol)\s+{_I}", "function": r"^\s*[-+]\s*\([^)]*\)\s*(\w+)", "import": r"^\s*#\s*(?:import|include)\s*[<\"]([^>\"]+)[>\"]"}),
    **dict.fromkeys(["java", "cs", "dart"], {**_C, "import": _BRACES["import"]}),
    **dict.fromkeys("kt kts scala swift".split(), _BRACES),
    "go": {**_BRACES, "type": rf"\b(type)\s+{_I}\s+(?:struct|interface)", "import": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$"},
    "rs": {**_BRACES, "type": rf"\b(struct|enum|trait|impl|union)\s+(?:<[^>]*>\s*)?{_I}", "import": r"^\s*use\s+([\w:]+)"},
    "php": {**_BRACES, "import": r"^\s*use\s+([\w\\]+)"},
    "rb": {"type": rf"^\s*(class|module)\s+{_I}", "function": rf"^\s*def\s+(?:self\.)?{_I}", "import": r"(?!)"},
    "lua": {"type": r"(?!)()()", "function": rf"\bfunction\s+(?:\w+[.:])?{_I}\s*\(", "import": r"require\s*\(?\s*['\"]([^'\"]+)"},
    "jl": {"type": rf"\b(struct|module|abstract type|primitive type)\s+{_I}", "function": rf"\bfunction\s+{_I}\s*\(", "import": r"^\s*(?:using|import)\s+([\w.]+)"},
    **dict.fromkeys(["ex", "exs"], {"type": r"\b(defmodule|defprotocol)\s+([\w.]+)", "function": rf"\bdefp?\s+{_I}", "import": r"^\s*(?:alias|import|require|use)\s+([\w.]+)"}),
    "zig": {"type": rf"\b(const)\s+{_I}\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)", "function": rf"\bfn\s+{_I}\s*\(", "import": r"@c?[iI]mport\(\s*\"([^\"]+)\""},
    "ps1": {"type": rf"^\s*(class|enum)\s+{_I}", "function": r"^\s*function\s+([\w-]+)", "import": r"^\s*using\s+(?:module|namespace|assembly)\s+([\w.]+)"},
    **dict.fromkeys(["v", "sv"], {"type": rf"^\s*(module|interface|class|package)\s+{_I}", "function": rf"^\s*(?:function|task)\s+(?:automatic\s+)?(?:[\w\[\]:]+\s+)?{_I}", "import": r"^\s*import\s+([\w:*]+)"}),
}
_CALL = re.compile(rf"(?:{_I}\([^()]*\)\.)?((?:[\w$]+(?:::|->|\.))*[\w$]+)\s*\(")
_WORDS = frozenset("if for while switch catch return function def fn func fun new sizeof match else elif unless until when with print and or not in super do try throw throws await async foreach include require import using use module class struct enum".split())


def import_target(module: str, ext: str, path: str = "") -> str:
    """The name under which an imported module may be a node; relative ones of scripts are paths, without a look at any file."""
    if ext in ("c", "h", "cc", "cpp", "cxx", "hpp", "m", "mm", "zig"):
        return module.rsplit("/", 1)[-1].split(".")[0]
    if ext == "go":
        return "go_pkg_" + module
    if ext in ("js", "jsx", "mjs", "ts", "tsx", "vue", "svelte"):
        if not module.startswith("."):
            return module.rsplit("/", 1)[-1]
        return posixpath.normpath(posixpath.join(posixpath.dirname(path), re.sub(r"\.jsx?$", lambda m: ".tsx" if m[0] == ".jsx" else ".ts", module)))
    if ext == "lua":
        return module
    if ext == "java" and module.endswith(".*"):
        module = module[:-2]
    parts = [p for p in re.split(r"::|[.\\]", module) if p and p not in ("*", "_")]
    return parts[-1] if parts else module


def declared(r: Rows, text: str, ext: str, shift: int = 0) -> None:
    """Types, functions, calls and imports by patterns; a declaration belongs to the last open type that is indented less."""
    lang = {k: re.compile(v) for k, v in LANGUAGES[ext].items()}
    owners: list[tuple[int, str, str]] = []
    current, lines_of = r.file_id, text.splitlines()
    for no, line in enumerate(lines_of, 1 + shift):
        if not line.strip() or line.lstrip().startswith(("//", "#!", "*", "--")):
            continue
        indent = len(line) - len(line.lstrip())
        owners = [o for o in owners if o[0] < indent] if re.match(r"\s*[\w@$#(]", line) else owners
        m = lang["import"].search(line)
        if m:
            r.brings(import_target(m[1], ext, r.path), None, "imports_from" if ext in ("go", "rs", "zig", "ps1") or LANGUAGES[ext] is _JS else "imports", no)
            continue
        m = lang["type"].search(line)
        if m and m.lastindex and m.lastindex >= 2 and m[2]:
            me = slug(f"{_scope(r, ext)}_{m[2]}")
            kind = {"defmodule": "module", "const": "struct", "type": "struct", "impl": "impl", "interface": "class" if ext in ("m", "mm") else "interface", "implementation": "impl"}.get(m[1], m[1].replace(" ", "_"))
            if kind != "impl" and not (kind == "extension" and ext == "swift"):
                r.node(me, m[2], kind, no)
                r.edge(owners[-1][1] if owners else r.file_id, me, "contains", no)
            base = re.search(rf"(?:extends|implements|:|<)\s*{_I}", line[m.end() :])
            if base and ext not in ("go", "rs", "zig", "v", "sv", "ex", "exs") and base[1] not in _WORDS:
                r.inherits(me, base[1], no)
            for adopted in re.findall(r"[<,]\s*(\w+)", re.sub(r"^[^<]*", "", line)) if ext in ("m", "mm") else ():
                r.edge(r.file_id, slug(adopted), "imports", no)
            owners.append((indent, me, m[2]))
            current = me
            continue
        if ext == "swift" and owners:
            for case in re.findall(r"\w+", m2[1]) if (m2 := re.match(r"\s*case\s+([\w\s,]+?)\s*(?:[=({]|$)", line)) else ():
                r.edge(owners[-1][1], r.node(slug(f"{r.stem}_{owners[-1][2]}_{case}"), case, "case", no), "case_of", no)
            if m2 := re.match(r"\s*(deinit|init|subscript)\b", line):
                current = r.node(slug(f"{r.stem}_{owners[-1][2]}_{m2[1]}"), f".{m2[1]}()", "function", no)
                r.edge(owners[-1][1], current, "method", no)
                continue
        m = lang["function"].search(line)
        name = next((x for x in m.groups() if x), None) if m else None
        if ext == "go" and (of := re.match(rf"\s*func\s*\(\s*\w*\s*\*?{_I}", line)) and name:
            # A method belongs to its receiver's type, which may stand in another file of the package.
            owner = slug(f"{_scope(r, ext)}_{of[1]}")
            me = r.node(slug(f"{owner}_{name}"), f".{name}()", "function", no)
            r.edge(owner, me, "method", no)
            current, line, name = me, line[m.end() :], None
        if ext in ("rs", "go", "ts", "tsx", "swift", "kt") and (to := re.search(r"\b(?:fn|func|function|fun)\s+(?:\([^)]*\)\s*)?(\w+)[^{]*?\)\s*(?:->|:|(?=\*?\w))\s*([^{]+)", lines_of[no - 1 - shift])):
            r.gives(to[1], _type_name(to[2]), no)
        if name and (name == "new" or name not in _WORDS):
            own = owners[-1] if owners else None
            me = r.node(slug(f"{r.stem}_{own[2]}_{name}" if own else f"{r.stem}_{name}"), f".{name}()" if own else f"{name}()", "function", no)
            r.edge(own[1] if own else r.file_id, me, "method" if own else "contains", no)
            current, line = me, line[m.end() :]
        if ext in ("kt", "kts"):
            continue  # calls aren't told from constructors there
        for c in _CALL.finditer(line):
            if c[2] not in _WORDS:
                r.call(current, c[2], no, c[1])
        for c in re.finditer(r"\[\s*[\w.]+\s+(\w+)", line) if ext in ("m", "mm") else ():
            r.call(current, c[1], no)
    if ext == "php":
        php_relations(r, text)


def _scope(r: Rows, ext: str) -> str:
    """What ids of a file begin with: its package's folder in Go, where files share one scope, else its stem."""
    return posixpath.basename(posixpath.dirname(r.path)) or r.stem if ext == "go" else r.stem


_NO_TYPE = frozenset("Self self dyn impl mut const static where ref Result Option Box Arc Rc Vec str String bool void number string any unknown never Promise error int".split())


def _type_name(written: str) -> str | None:
    """The last name of a written return type that is no keyword, wrapper or built-in."""
    return next((w for w in reversed(re.findall(r"[A-Za-z_]\w*", written)) if w not in _NO_TYPE), None)


_PHP = [
    ("uses_config", re.compile(r"\bconfig\s*\(\s*['\"]([^'\"]+)['\"]")),
    ("uses_static_prop", re.compile(r"([A-Z][\w\\]*)::\$\w+")),
    ("references_constant", re.compile(r"([A-Z][\w\\]*)::[A-Z][A-Z0-9_]*\b(?!\s*\()")),
]
_BIND = re.compile(r"->(?:bind|singleton|scoped|instance)\s*\(\s*([\w\\]+)::class\s*,\s*([\w\\]+)::class")
_LISTEN = re.compile(r"([\w\\]+)::class\s*=>\s*\[(.*?)\]", re.S)


def php_relations(r: Rows, text: str) -> None:
    """Configuration keys, static properties, constants, bindings and listeners that name something of the same file."""
    nodes = [x for x in r.out if x["part"] == "node"]
    by = {x["label"].lower(): x["id"] for x in nodes}
    starts = sorted((x["line"], x["id"]) for x in nodes if x["kind"] == "function")
    find = lambda name: by.get(name.rsplit("\\", 1)[-1].lower())
    seen: set[tuple] = set()

    def add(a: str | None, b: str | None, relation: str, at: int) -> None:
        if a and b and a != b and (a, b, relation) not in seen:
            seen.add((a, b, relation))
            r.edge(a, b, relation, text.count("\n", 0, at) + 1)

    for relation, pattern in _PHP:
        for m in pattern.finditer(text):
            line = text.count("\n", 0, m.start()) + 1
            inside = [i for n, i in starts if n <= line]
            key = m[1].split(".")[0].lower() if relation == "uses_config" else m[1]
            add(inside[-1] if inside else None, (by.get(key) or by.get(f"{key}.php")) if relation == "uses_config" else find(key), relation, m.start())
    for m in _BIND.finditer(text):
        add(find(m[1]), find(m[2]), "bound_to", m.start())
    if "$listen" in text or "$subscribe" in text:
        for m in _LISTEN.finditer(text):
            for x in re.finditer(r"([\w\\]+)::class", m[2]):
                add(find(m[1]), find(x[1]), "listened_by", m.start(2) + x.start())


_SCRIPT = re.compile(r"(?is)<script([^>]*)>(.*?)</script>")


def extract_file(path: str, text: str) -> list[dict]:
    """All rows of one file; unknown kinds of files give none."""
    ext = path.rsplit(".", 1)[-1].lower()
    r = Rows(path)
    if ext != "py" and ext not in LANGUAGES:
        return []
    r.node(r.file_id, path.rsplit("/", 1)[-1], "file", 1)
    if ext == "py":
        python(r, text)
    elif ext in ("vue", "svelte"):
        for m in _SCRIPT.finditer(text):
            declared(r, m[2], "ts" if re.search(r"lang\s*=\s*['\"]ts", m[1]) else "js", text.count("\n", 0, m.start(2)))
    else:
        declared(r, text, ext)
    return r.close()


def extract(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA for files (path, text); null texts count as empty."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [x for p, t in zip(b["path"], b["text"]) for x in extract_file(p, t or "")]
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="int32" if c in ("line", "pos") else object) for c in columns})

    return files.select("path", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, SCHEMA)


def tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, calls) of extracted rows, in the order of paths, then of rows in their file."""
    rows = number_rows(rows, [F.col("path"), F.col("pos")], "ord")
    kind = F.when(F.col("kind") == "rationale", F.lit("rationale")).otherwise(F.lit("code"))
    place = F.when(F.col("kind") == "placeholder", F.lit("")).otherwise
    nodes = rows.filter("part = 'node'").select("id", "label", kind.alias("file_type"), place(F.col("path")).alias("source_file"), place(F.concat(F.lit("L"), F.col("line").cast("string"))).alias("source_location"), F.when(F.col("kind") != "placeholder", F.col("kind")).alias("node_type"), "docstring", "ord")
    edges = rows.filter("part = 'edge'").select("source", "target", "relation", F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight"), F.col("path").alias("source_file"), "ord")
    calls = rows.filter("part = 'call'").select(F.col("source").alias("caller"), "callee", "receiver", F.col("path").alias("source_file"), "ord")
    return nodes, edges, calls


def code_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of extracted rows with everything that is joined over them.

    Nodes that several files give (placeholders, packages) are merged, those with
    a source file before those without.  Calls are looked up in their own file
    first, there EXTRACTED, then in all files and by their receivers' types;
    names that Python files import are used by the classes there.
    """
    nodes, edges, calls = tables(rows)
    named = nodes.filter("source_file <> ''").select(F.col("id").alias("_i")).distinct()
    alone = nodes.filter("source_file = ''").join(named, F.col("id") == F.col("_i"), "left_anti")
    nodes = merge_nodes(nodes.filter("source_file <> ''").unionByName(alone))
    shape = lambda df: df.select("source", "target", "relation", "confidence", "weight", "ord")
    own = shape(edges)
    near = calls_in_files(nodes, calls).join(own.select(F.col("source").alias("_s"), F.col("target").alias("_t")), (F.col("source") == F.col("_s")) & (F.col("target") == F.col("_t")), "left_anti")
    have = own.unionByName(shape(near))
    returns = rows.filter("part = 'return'").select(F.col("name").alias("function_name"), F.col("module").alias("return_type_name"))
    far = resolve_calls(nodes, have, calls, returns)
    py = nodes.filter(F.col("source_file").endswith(".py") & (F.col("node_type") != "file"))
    entities = py.select("id", "label", F.regexp_extract("source_file", r"([^/]*)\.py$", 1).alias("module"), "source_file", F.col("node_type").alias("kind"))
    imports = rows.filter("part = 'import' and name is not null").select(F.col("path").alias("source_file"), "module", "name", "line")
    uses = import_uses(entities, imports).filter("source <> target").withColumn("ord", F.col("line").cast("bigint"))
    return nodes, have.unionByName(shape(far)).unionByName(shape(uses))
