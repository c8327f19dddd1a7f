"""Queries of what the other catalogues leave out: merges, texts of answers, search and label forms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import pipeline
from weftgraph.functions import text as T
from weftgraph.operators import calls, normalize, query, traverse
from weftgraph.plans import texts
from weftgraph.plans.oracle import BASE
from weftgraph.sources import extract, ingest
from weftgraph.sources.derived import graph, raw_edges, raw_nodes, table

COLOURS = ", ".join(f"'{c}'" for c in T.PALETTE)
QUESTION = "which supplier serves region europe"


def _text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "text string")


def stats_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, query.stats(graph(spark, sf_dir)))


def god_nodes_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, query.god_nodes(graph(spark, sf_dir)))


def community_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, query.community(graph(spark, sf_dir), 203))


def neighbors_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, query.neighbors(graph(spark, sf_dir), "supplier_3", "contains"))


def explain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, query.explain(graph(spark, sf_dir), "nation_3"))


def path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, query.path_text(graph(spark, sf_dir), "nation_3", "nation_8"))


def search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.starts(graph(spark, sf_dir), traverse.terms(QUESTION), 5)


def shortest_path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traverse.path(graph(spark, sf_dir), "nation_3", "part_7") or []
    return spark.createDataFrame(list(enumerate(found)), "at int, id string")


def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines that an answer is cut from: of nodes by degree, then of the edges by which they were met."""
    g = graph(spark, sf_dir)
    start = traverse.starts(g, traverse.terms("nation_3 germany"), 3).select("id")
    return query.subgraph_lines(g, traverse.tree(g, start, 1).checkpoint()).select("part", "at", "key", "line")


def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes written three times: the last label stays at the first position."""
    n = raw_nodes(spark, sf_dir)
    again = n.filter("ord % 3 <> 0").withColumns({"label": F.upper("label"), "ord": F.col("ord") + 10_000_000_000})
    last = n.filter("ord % 5 = 0").withColumns({"label": F.concat("label", F.lit("!")), "ord": F.col("ord") + 20_000_000_000})
    return normalize.merge_nodes(n.unionByName(again).unionByName(last)).select("id", "label", "ord")


def label_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after parts of one type, and customers of one segment and nation, got one label each."""
    g = graph(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("_i"), F.concat(F.lit("Type "), (F.col("p_size") % 7).cast("string")).alias("_l"))
    p = p.select(g.key(F.col("_i")).alias("code"), "_l")
    n = g.known_ranked.select("code", "id", "ord", "label").join(p, "code", "left").withColumn("label", F.coalesce("_l", "label")).drop("_l")
    return normalize.merge_labels(n, g.links)[1].select("source", "target", "relation", "weight", "spos", "tpos")


def receiver_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls f().m(): f returns the type of its nation, m is a method there if only one supplier of that nation bears its name."""
    s = table(spark, sf_dir, "supplier")
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    types = s.select(key("type_", "s_nationkey").alias("id"), key("Type", "s_nationkey").alias("label"), F.col("s_nationkey").cast("bigint").alias("ord")).distinct()
    methods = s.select(key("m_", "s_suppkey").alias("id"), F.concat(F.lit(".go"), (F.col("s_suppkey") % 13).cast("string"), F.lit("()")).alias("label"), (F.col("s_suppkey") + 1000).cast("bigint").alias("ord"))
    edges = s.select(key("type_", "s_nationkey").alias("source"), key("m_", "s_suppkey").alias("target"), F.lit("method").alias("relation"))
    asked = table(spark, sf_dir, "customer").select(key("c_", "c_custkey").alias("caller"), F.concat(F.lit("x.Go"), (F.col("c_custkey") % 17).cast("string")).alias("callee"), F.concat(F.lit("make"), F.col("c_nationkey").cast("string")).alias("receiver"), F.col("c_custkey").cast("bigint").alias("ord"))
    returns = s.select(F.concat(F.lit("Make"), F.col("s_nationkey").cast("string")).alias("function_name"), key("Type", "s_nationkey").alias("return_type_name"))
    direct = calls.method_index(types.unionByName(methods), edges)
    by = calls.receiver_targets(asked.withColumn("call", F.xxhash64("caller", "callee", "ord")), returns, direct)
    return by.select(F.col("caller").alias("source"), "target")


def label_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    odd = F.concat(F.char(F.lit(9)), "p_name", F.lit(" a/b: c"), F.char(F.lit(127)))
    value = F.col("p_partkey") * 1000 / 8
    return p.select(
        "p_partkey", T.sanitize_label(odd).alias("clean"), T.wiki_name(F.concat("p_name", F.lit("/x: y"))).alias("wiki"), T.thousands(F.col("p_partkey") * 12345).alias("thousands"), T.trim_float(value).alias("trimmed"),
        T.colour(F.col("p_size").cast("bigint")).alias("colour"), T.fenced_json(F.concat(F.lit("```json\n{\"a\": "), F.col("p_size").cast("string"), F.lit("}\n```"))).alias("body"), T.html_escape(F.concat(F.lit("<b title=\"x\">&'"), "p_name")).alias("html"), T.percent_escape(F.concat("p_name", F.lit(" *~é/"))).alias("percent"),
        T.is_lock_file(F.concat(F.lit("a/"), F.when(F.col("p_partkey") % 3 == 0, F.lit("Cargo.lock")).when(F.col("p_partkey") % 3 == 1, F.lit("poetry.lock")).otherwise(F.lit("unlock.py")))).alias("lock"),
    )


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    key = F.col("page_id").cast("string")
    paper = F.concat(F.lit("https://arxiv.org/abs/"), F.lpad(key, 4, "1"), F.lit("."), F.lpad(key, 5, "2"), F.lit("v2"))
    repo = F.concat(F.lit("https://github.com/own-"), key, F.lit("/re.po_"), key, F.when(F.col("page_id") % 2 == 0, F.lit(".git")).otherwise(F.lit("/")))
    return p.select("page_id", T.arxiv_id(paper).alias("arxiv"), T.github_repo(repo).alias("repo"), T.utc_stamp(F.col("page_id").cast("bigint") * 86461).alias("stamp"), T.utc_file_stamp(F.col("page_id").cast("bigint") * 86461).alias("file_stamp"))


def path_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative imports of pages, resolved without a look at any file."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 4
    spec = F.when(k == 0, F.lit("./a/../b.js")).when(k == 1, F.lit("../../x.jsx")).when(k == 2, F.lit("./c/./d")).otherwise(F.lit("../e.ts"))
    return p.select("page_id", T.resolve_import(F.concat(F.lit("src/p"), F.col("page_id").cast("string"), F.lit("/q/main.ts")), spec).alias("target"))


def page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.page_notes(table(spark, sf_dir, "pages"), "2024-03-01T12:00:00Z", "some \"one\"")


def code_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a file for each supplier: a class with a base, a method that calls a function, and the next file's class imported by name."""
    k, after = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") + 1).cast("string")
    base = (F.col("s_suppkey") % 5).cast("string")
    text = F.concat(F.lit("from f"), after, F.lit(" import C"), after, F.lit("\n\n\nclass C"), k, F.lit("(Base"), base, F.lit("):\n    def run"), k, F.lit("(self):\n        return help"), k, F.lit("()\n\n\ndef help"), k, F.lit("():\n    return 1\n"))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s/f"), k, F.lit(".py")).alias("path"), text.alias("text"))
    return extract.code_graph(extract.extract(files))[1].select("source", "target", "relation", "confidence")


def extraction_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' graph and suppliers' graph as two extractions: one graph, in which the later edges of a pair win."""
    n, e = raw_nodes(spark, sf_dir), raw_edges(spark, sf_dir).filter("kind <= 3").withColumn("ord", F.col("kind").cast("bigint") * 1_000_000_000 + F.col("k1"))
    again = e.filter("k1 % 2 = 0").withColumns({"relation": F.lit("describes"), "weight": F.lit(0.5)})
    return pipeline.merge([(n, e), (n.filter("ord % 2 = 0").withColumn("label", F.lower("label")), again)]).edges.select("source", "target", "relation", "weight")


def queries():
    names = (stats_text, god_nodes_text, community_text, neighbors_text, explain_text, path_text, search_top, shortest_path_nodes, answer_lines, node_merge, label_merge_edges, receiver_calls, label_forms, url_parts, path_forms, page_notes, code_extraction, extraction_union)
    return {f.__name__: f for f in names}


def sql():
    pages = texts.sql()
    conn = ", near AS (select distinct id, other from ends where id <> other)"
    levels = conn + ", l0 AS (select 'nation_3' id, 0 level, null::varchar parent)"
    for k in range(1, 5):
        before = " union all ".join(f"select id from l{j}" for j in range(k))
        levels += f", l{k} AS (select other id, {k} level, min(near.id) parent from near join l{k - 1} f on f.id = near.id where other not in ({before}) group by other)"
    walk = ", seen AS (" + " union all ".join(f"select * from l{j}" for j in range(5)) + "), back AS (select id, level, parent from seen where id = 'part_7' union all select s.id, s.level, s.parent from back b join seen s on s.id = b.parent)"
    words = ["which", "supplier", "serves", "region", "europe"]
    score = " + ".join(f"contains(lower(label), '{w}')::int * 2 + contains(lower(source_file), '{w}')::int" for w in words)
    few = " + ".join(f"contains(lower(label), '{w}')::int * 2 + contains(lower(source_file), '{w}')::int" for w in ("nation_3", "germany"))
    slug = r"lower(regexp_replace(regexp_replace({}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"
    file_of = "(label <> '' and source_file <> '' and ((split_part(source_file, '/', -1) = label) or (label like '.%()') or (label like '%()' and degree <= 1)))"
    pct = lambda c: f"round(100.0::double * count(*) filter (where {c}) / count(*))::bigint"
    _X, _I, _A = "confidence not in ('INFERRED', 'AMBIGUOUS')", "confidence = 'INFERRED'", "confidence = 'AMBIGUOUS'"
    hex_ = "hex(encode(c))"
    percent = f"array_to_string(list_transform(string_split(p_name||' *~é/', ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9_.~-]$') THEN c ELSE regexp_replace({hex_}, '(..)', '%\\1', 'g') END), '')"
    return {
        "stats_text": BASE + f", s AS (select count(*) e, {pct(_X)} x, {pct(_I)} i, {pct(_A)} a from edges) select 'Nodes: '||(select count(*) from fx_nodes)||chr(10)||'Edges: '||e||chr(10)||'Communities: '||(select count(distinct cid) from comm)||chr(10)||'EXTRACTED: '||x||'%'||chr(10)||'INFERRED: '||i||'%'||chr(10)||'AMBIGUOUS: '||a||'%'||chr(10) \"text\" from s",
        "god_nodes_text": BASE + f", d AS (select id, count(distinct other) degree from ends group by id), r AS (select n.*, coalesce(d.degree, 0) degree from fx_nodes n left join d using (id)), t AS (select label, degree, row_number() over (order by degree desc, id) k from r where not {file_of} and source_file <> '' and contains(split_part(source_file, '/', -1), '.') order by degree desc, id limit 10) select 'God nodes (most connected):'||chr(10)||string_agg('  '||k||'. '||label||' - '||degree||' edges', chr(10) order by k) \"text\" from t",
        "community_text": BASE + " select 'Community 203 ('||count(*)||' nodes):'||chr(10)||string_agg('  '||label||' ['||source_file||']', chr(10) order by label, id) \"text\" from comm join fx_nodes on id = node_id where cid = 203",
        "neighbors_text": BASE + ", t AS (select other id, relation, confidence from ends where id = 'supplier_3' and contains(relation, 'contains')) select 'Neighbors of supplier_3:'||chr(10)||string_agg('  --> '||label||' ['||relation||'] ['||confidence||']', chr(10) order by id) \"text\" from t join fx_nodes using (id)",
        "explain_text": BASE + ", d AS (select id, count(distinct other) degree from ends group by id), t AS (select other id, relation, confidence from ends where id = 'nation_3'), u AS (select label, relation, confidence, row_number() over (order by r.degree desc, id) k from t join ranked r using (id)), me AS (select n.*, d.degree, cid from fx_nodes n join d using (id) join comm on node_id = id where id = 'nation_3') select 'Node: '||label||chr(10)||'  ID:        '||id||chr(10)||'  Source:    '||source_file||chr(10)||'  Type:      '||file_type||chr(10)||'  Community: '||cid||chr(10)||'  Degree:    '||degree||chr(10)||chr(10)||'Connections ('||degree||'):'||chr(10)||(select string_agg('  --> '||label||' ['||relation||'] ['||confidence||']', chr(10) order by k) from u where k <= 20)||case when degree > 20 then chr(10)||'  ... and '||(degree - 20)||' more' else '' end \"text\" from me",
        "path_text": "select 'Shortest path (2 hops):'||chr(10)||'  '||a.n_name||' --contains [EXTRACTED]--> '||r_name||' --contains [EXTRACTED]--> '||b.n_name \"text\" from nation a join nation b using (n_regionkey) join region on r_regionkey = n_regionkey where a.n_nationkey = 3 and b.n_nationkey = 8",
        "search_top": BASE + f", s AS (select id, {score} score from fx_nodes), t AS (select * from s where score > 0 order by score desc, id desc limit 5) select id, score, row_number() over (order by score desc, id desc)::int rank from t",
        "shortest_path_nodes": BASE.replace("WITH ", "WITH RECURSIVE ", 1) + levels + walk + " select level::int \"at\", id from back",
        "answer_lines": BASE + conn + f""", s AS (select id, {few} score from fx_nodes), st AS (select id from s where score > 0 order by score desc, id desc limit 3),
l1 AS (select other id, min(near.id) parent from near join st on st.id = near.id where other not in (select id from st) group by other), v AS (select id, null::varchar parent, 0 lv from st union all select id, parent, 1 from l1), d AS (select id, count(distinct other) degree from ends group by id)
select 0::int part, -coalesce(d.degree, 0) "at", n.id "key", 'NODE '||n.label||' [src='||n.source_file||' loc= community='||coalesce(cid::varchar, '')||']' line from v join fx_nodes n using (id) left join d using (id) left join comm on node_id = n.id
union all select 1, lv, v.parent||'|'||v.id, 'EDGE '||a.label||' --'||e.relation||' ['||e.confidence||']--> '||b.label from v join fx_nodes a on a.id = v.parent join fx_nodes b on b.id = v.id join edges e on least(e.source, e.target) = least(v.id, v.parent) and greatest(e.source, e.target) = greatest(v.id, v.parent)""",
        "node_merge": BASE + ", u AS (select id, label, ord from fx_nodes union all select id, upper(label), ord + 10000000000 from fx_nodes where ord % 3 <> 0 union all select id, label||'!', ord + 20000000000 from fx_nodes where ord % 5 = 0) select id, arg_max(label, ord) label, min(ord) ord from u group by id",
        "label_merge_edges": BASE + f""", n AS (select id, ord, case when id like 'part%' then 'Type '||(p_size % 7)::varchar else label end label from fx_nodes left join part on id = 'part_'||p_partkey::varchar), k AS (select id, ord, {slug.format('label')} s from n), g AS (select *, case when s <> '' then 's'||s else 'i'||id end key from k),
o AS (select *, ord = min(ord) over (partition by key) or not contains(id, '_chunk') ok from g), b AS (select key, arg_min(id, (octet_length(encode(id)), ord)) filter (where ok) keep from o group by key), m AS MATERIALIZED (select id, keep from o join b using (key)), x AS MATERIALIZED (select a.keep ks, e.target t, relation, weight, spos, tpos from edges e join m a on a.id = e.source),
y AS MATERIALIZED (select ks, b.keep kt, relation, weight, spos, tpos from x join m b on b.id = t) select ks source, kt target, relation, weight, spos, tpos from y where ks <> kt""",
        "receiver_calls": "WITH m AS (select s_nationkey n, s_suppkey % 13 k, min(s_suppkey) s, count(*) c from supplier group by all having count(*) = 1) select 'c_'||c_custkey::varchar source, 'm_'||s::varchar target from customer join m on n = c_nationkey and k = c_custkey % 17",
        "label_forms": f"""select p_partkey, substr(p_name||' a/b: c', 1, 256) clean, replace(replace(replace(p_name||'/x: y', '/', '-'), ' ', '_'), ':', '-') wiki, format('{{:,}}', p_partkey * 12345) thousands, regexp_replace(regexp_replace(printf('%.2f', p_partkey * 1000 / 8.0::double), '0+$', ''), '\\.$', '') trimmed,
[{COLOURS}][(p_size % 10 + 1)::int] colour, '{{"a": '||p_size||'}}' body, '&lt;b title=&quot;x&quot;&gt;&amp;&#39;'||p_name html, {percent} "percent", p_partkey % 3 < 2 "lock" from part""",
        "url_parts": "select page_id, lpad(page_id::varchar, 4, '1')||'.'||lpad(page_id::varchar, 5, '2') arxiv, 'own-'||page_id||'/re.po_'||page_id repo, strftime(to_timestamp(page_id::bigint * 86461) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') stamp, strftime(to_timestamp(page_id::bigint * 86461) at time zone 'UTC', '%Y%m%d_%H%M%S') file_stamp from pages",
        "page_notes": f"""with t as ({pages['page_titles']}), h as ({pages['html_to_text']}), f as ({pages['safe_filenames']})
select p.page_id, f.name, '---'||chr(10)||'source_url: "'||url||'"'||chr(10)||'type: webpage'||chr(10)||'title: "'||replace(replace(title, '\\', '\\\\'), '"', '\\"')||'"'||chr(10)||'captured_at: 2024-03-01T12:00:00Z'||chr(10)||'contributor: "some \\"one\\""'||chr(10)||'---'||chr(10)||chr(10)||'# '||title||chr(10)||chr(10)||'Source: '||url||chr(10)||chr(10)||'---'||chr(10)||chr(10)||h.body||chr(10) "content"
from pages p join t using (page_id) join h using (page_id) join f using (page_id)""",
        "code_extraction": f"""select 's_f'||s_suppkey||'_py' source, 'f'||s_suppkey||'_c'||s_suppkey target, 'contains' relation, 'EXTRACTED' confidence from supplier
union all select 's_f'||s_suppkey||'_py', 'f'||s_suppkey||'_help'||s_suppkey, 'contains', 'EXTRACTED' from supplier union all select 'f'||s_suppkey||'_c'||s_suppkey, 'f'||s_suppkey||'_c'||s_suppkey||'_run'||s_suppkey, 'method', 'EXTRACTED' from supplier
union all select 'f'||s_suppkey||'_c'||s_suppkey||'_run'||s_suppkey, 'f'||s_suppkey||'_help'||s_suppkey, 'calls', 'EXTRACTED' from supplier union all select 'f'||s_suppkey||'_c'||s_suppkey, 'base'||s_suppkey % 5, 'inherits', 'EXTRACTED' from supplier
union all select 's_f'||s_suppkey||'_py', 'f'||(s_suppkey + 1), 'imports_from', 'EXTRACTED' from supplier union all select 'f'||a.s_suppkey||'_c'||a.s_suppkey, 'f'||b.s_suppkey||'_c'||b.s_suppkey, 'uses', 'INFERRED' from supplier a join supplier b on b.s_suppkey = a.s_suppkey + 1""",
        "extraction_union": BASE + ", r as (select * from fx_raw where kind <= 3), u as (select s0, t0, relation, weight, 0 part from r union all select s0, t0, 'describes', 0.5, 1 from r where k1 % 2 = 0) select a.id source, b.id target, relation, weight from u join fx_nodes a on a.id = s0 join fx_nodes b on b.id = t0 qualify row_number() over (partition by s0, t0 order by part desc) = 1",
        "path_forms": "select page_id, case page_id % 4 when 0 then 'src/p'||page_id||'/q/b.ts' when 1 then 'src/x.tsx' when 2 then 'src/p'||page_id||'/q/c/d' else 'src/p'||page_id||'/e.ts' end target from pages",
    }
