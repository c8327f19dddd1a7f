"""Queries of text columns, sections, name resolution and change batches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.folding import MANY, ONE, norm_label
from weftgraph.operators import calls, sections
from weftgraph.plans.oracle import BASE
from weftgraph.sources.derived import graph, raw_nodes, table
from weftgraph.streaming import watch


def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(table(spark, sf_dir, "documents"))


def paper_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.paper_signals(F.col("text")).alias("signals"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum(T.word_count(F.col("text"))).alias("words"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


def fold_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", norm_label(F.col("text")).alias("folded"))


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("body"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.page_title(F.col("html"), F.col("url")).alias("title"))


def url_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_type(F.col("url")).alias("kind"))


def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_file_name(F.col("url"), ".md").alias("name"))


def question_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.question_slug(F.col("text")).alias("slug"), T.token_estimate(F.col("text")).alias("tokens"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("digest"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of events: folder by type, ending by value."""
    kinds = F.array(*map(F.lit, (".py", ".rs", ".md", ".pdf", ".png", ".key", ".docx", ".mp4", ".lock", "")))
    end = F.element_at(kinds, (F.pmod(F.col("event_id"), F.lit(10)) + 1).cast("int"))
    folders = F.array(*map(F.lit, ("src", "tokenizer", "node_modules", "docs/a.imageset", "my_venv", "lib")))
    folder = F.element_at(folders, (F.pmod(F.col("user_id"), F.lit(6)) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(folder, F.lit("/"), "event_type", F.col("user_id").cast("string"), end).alias("path"))


def sensitive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("event_id", "path", T.is_sensitive(F.col("path")).alias("sensitive"), T.in_noise_folder(F.col("path")).alias("noise"))


def file_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf_dir).select("event_id", T.file_category(p).alias("category"), T.top_folder(p).alias("top"), T.file_type(p).alias("kind"))


def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call customers by name behind a separator, and suppliers by the key of their clerk; the graph's own pairs are known already."""
    g = graph(spark, sf_dir)
    seps = F.array(F.lit("crm."), F.lit("Crm::"), F.lit("this->"), F.lit("a/"), F.lit(""))
    sep = F.element_at(seps, (F.pmod(F.col("o_orderkey"), F.lit(5)) + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    o = table(spark, sf_dir, "orders").join(c, "o_custkey")
    raw = o.select(F.concat(F.lit("orders_"), F.col("o_orderkey").cast("string")).alias("caller"), F.concat(sep, F.upper("c_name"), F.lit("()")).alias("callee"), F.lit(None).cast("string").alias("receiver"), F.col("o_orderkey").alias("ord"))
    return calls.resolve_calls(raw_nodes(spark, sf_dir), g.edges, raw).select("source", "target", "relation", "confidence", "confidence_score", "weight")


def import_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are entities of their nation's module; every customer's file imports the supplier of its own key."""
    s = table(spark, sf_dir, "supplier")
    entities = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("label"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("module"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".py")).alias("source_file"), F.when(F.pmod("s_suppkey", F.lit(3)) == 0, F.lit("function")).otherwise(F.lit("class")).alias("kind"))
    imports = s.select(F.concat(F.lit("n"), F.pmod(F.col("s_nationkey") + 1, F.lit(25)).cast("string"), F.lit(".py")).alias("source_file"), F.concat(F.lit("pkg.n"), F.col("s_nationkey").cast("string")).alias("module"), F.col("s_name").alias("name"), (F.pmod("s_suppkey", F.lit(40)) + 1).cast("int").alias("line"))
    return calls.import_uses(entities, imports)


def _snapshot(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.pmod("event_id", F.lit(3)) != odd)
    return e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".py")).alias("path")).agg(F.count("*").alias("size"), F.max(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("mtime"), F.lit("code").alias("file_type"))


def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.incremental(_snapshot(spark, sf_dir, 0), _snapshot(spark, sf_dir, 1))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.snapshot_diff(_snapshot(spark, sf_dir, 0), _snapshot(spark, sf_dir, 1))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "ts", F.when(F.col("event_type") == "error", F.lit("document")).otherwise(F.lit("code")).alias("file_type"), "user_id")


def sessions_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.debounced(_changes(spark, sf_dir), 3600, ["user_id"]).select("user_id", "start", "end", "changes")


def batch_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.debounced(_changes(spark, sf_dir), 600).select("start", "changes", "files", "action")


def queries():
    names = (doc_sections, paper_signals, word_counts, fold_label, html_to_text, page_titles, url_types, safe_filenames, question_slugs, content_hash, sensitive_paths, file_categories, call_resolution, import_uses, incremental_scan, snapshot_diff, sessions_debounce, batch_routing)
    return {"slug": slugs} | {f.__name__: f for f in names}


_WS = r"[ \t\n\v\f\r]"


def _signals() -> str:
    head = "substr(coalesce(text, ''), 1, 3000)"
    return " + ".join(f"regexp_matches({head}, '{p}')::int" for p in T.PAPER_SIGNALS)


def sql():
    quoted = ["".join(x).replace("'", "''") for x in (ONE, ONE.values())]
    folded = f"translate(text, '{quoted[0]}', '{quoted[1]}')"
    for k, v in MANY.items():
        folded = f"replace({folded}, '{k}', '{v}')"
    rest = r"regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://', '')"
    host = rf"lower(regexp_replace(regexp_replace(regexp_extract({rest}, '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
    path = rf"regexp_extract({rest}, '^[^/?#]*(.*)$', 1)"
    name = rf"substr(regexp_replace(regexp_replace(regexp_replace({host}||{path}, '[^\pL\pN_\-]', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g'), 1, 80)"
    ends = "['.py','.rs','.md','.pdf','.png','.key','.docx','.mp4','.lock','']"
    paths = f"p AS (select event_id, ['src','tokenizer','node_modules','docs/a.imageset','my_venv','lib'][user_id % 6 + 1]||'/'||event_type||user_id||{ends}[event_id % 10 + 1] path from events)"
    ext = "lower(split_part(path, '.', -1))"
    snap = "select 'u'||user_id||'.py' path, count(*) size, max(epoch_us(ts) / 1e6) mtime from events where event_id % 3 <> {} group by 1"
    strip = lambda x: rf"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"
    flat = lambda x: rf"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"
    label = lambda x: f"case when {flat(x)} = '' then 'Untitled section' when length({flat(x)}) > 80 then rtrim(substr({flat(x)}, 1, 79))||'…' else {flat(x)} end"
    head = rf"trim(regexp_replace({strip('line')}, '^#+', ''))"
    doc = rf"""WITH l AS (select doc_id, unnest(s) line, generate_subscripts(s, 1) no from (select doc_id, string_split(regexp_replace(replace(coalesce(text, ''), chr(13)||chr(10), chr(10)), '\n$', ''), chr(10)) s from documents)),
h AS (select *, {strip('line')} t, case when starts_with({strip('line')}, '#') and {head} <> '' then {head} end hd from l),
g AS (select *, sum((hd is not null)::int) over (partition by doc_id order by no) k, count(hd) over (partition by doc_id) heads, case when t <> '' and coalesce(lag(t) over (partition by doc_id order by no), '') = '' then 1 else 0 end st from h),
q AS (select *, sum(st) over (partition by doc_id order by no) para from g),
a AS (select doc_id, k, max(hd) hd, coalesce(min(no) filter (where hd is null and (k > 0 or t <> '')), min(no)) line, {strip("coalesce(string_agg(line, chr(10) order by no) filter (where hd is null and (k > 0 or t <> '')), '')")} body from q where heads > 0 group by doc_id, k),
b AS (select doc_id, para k, null hd, min(no) line, string_agg(line, chr(10) order by no) body from q where heads = 0 and t <> '' group by doc_id, para),
u AS (select * from a where hd is not null or body <> '' union all select * from b)
select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int "at", line::int line, coalesce(hd, {label('body')}) "label", body from u"""
    return {
        "slug": r"select page_id, lower(regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) slug from pages",
        "doc_sections": doc,
        "paper_signals": f"select doc_id, ({_signals()})::int signals from documents",
        "word_counts": rf"select lang, count(*) files, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda w: w <> '')))::bigint words from documents group by lang",
        "fold_label": f"select doc_id, lower({folded}) folded from documents",
        "html_to_text": rf"select page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g')), 1, 8000) body from pages",
        "page_titles": rf"select page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '{_WS}+', ' ', 'g')), ''), url) title from pages",
        "url_types": f"select page_id, case when contains(lower(url), 'twitter.com') or contains(lower(url), 'x.com') then 'tweet' when contains(lower(url), 'arxiv.org') then 'arxiv' when contains(lower(url), 'github.com') then 'github' when contains(lower(url), 'youtube.com') or contains(lower(url), 'youtu.be') then 'youtube' when lower({path}) like '%.pdf' then 'pdf' when regexp_matches(lower({path}), '[.](png|jpe?g|webp|gif)$') then 'image' else 'webpage' end kind from pages",
        "safe_filenames": f"select page_id, {name}||'.md' \"name\" from pages",
        "question_slugs": r"select conv_id, turn, coalesce(nullif(regexp_replace(lower(substr(regexp_replace(text, '[^A-Za-z0-9_]', '_', 'g'), 1, 50)), '^_+|_+$', '', 'g'), ''), 'query') slug, greatest(1, octet_length(encode(text)) // 4)::bigint tokens from conversations",
        "content_hash": "select doc_id, sha256(text) digest from documents",
        "sensitive_paths": f"WITH {paths} select event_id, path, regexp_matches(lower(path), '[.](env|pem|key)|token|secret|password|credential') sensitive, regexp_matches(path, '(^|/)(node_modules|build|dist|[^/]*_venv|[^/]*_env|venv|env)/') noise from p",
        "file_categories": f"WITH {paths} select event_id, case when {ext} in ('py','rs') then 'code' when {ext} = 'pdf' then 'paper' when {ext} = 'png' then 'image' else 'doc' end category, split_part(path, '/', 1) top, case event_id % 10 when 0 then 'code' when 1 then 'code' when 2 then 'document' when 3 then case when contains(path, '.imageset/') then null else 'paper' end when 4 then 'image' when 6 then 'document' when 7 then 'video' end kind from p",
        "call_resolution": BASE + """, names AS (select regexp_replace(lower(label), '[(]+[)]+$', '') k, id from fx_nodes qualify row_number() over (partition by k order by ord desc) = 1), c AS (select 'orders_'||o_orderkey s, lower(c_name) k from orders join customer on o_custkey = c_custkey)
select distinct s source, id target, 'calls' relation, 'INFERRED' confidence, 0.8::double confidence_score, 1.0::double weight from c join names using (k) where not exists (select 1 from edges e where e.source = s and e.target = id)""",
        "import_uses": """WITH t AS (select s_name "name", s_nationkey m, max('s'||s_suppkey) target from supplier group by all), i AS (select (s_nationkey + 1) % 25 f, s_nationkey m, s_name "name", (s_suppkey % 40 + 1)::int line from supplier)
select distinct 's'||l.s_suppkey source, target, line, 'uses' relation, 'INFERRED' confidence, 0.8::double weight from i join t using (m, "name") join supplier l on l.s_nationkey = i.f where l.s_suppkey % 3 <> 0""",
        "incremental_scan": f"WITH n AS ({snap.format(0)}), m AS ({snap.format(1)}) select coalesce(n.path, m.path) path, case when n.path is null then 'deleted' when m.path is null or n.mtime - m.mtime > 1e-6 then 'new' else 'unchanged' end state from n full join m on n.path = m.path",
        "snapshot_diff": f"WITH a AS ({snap.format(0)}), b AS ({snap.format(1)}) select * from (select coalesce(a.path, b.path) path, case when a.path is null then 'new' when b.path is null then 'removed' when a.size <> b.size or a.mtime <> b.mtime then 'changed' end \"change\", 'code' file_type from a full join b on a.path = b.path) where \"change\" is not null",
        "sessions_debounce": "WITH o AS (select user_id, ts, case when ts - lag(ts) over w >= interval 1 hour or lag(ts) over w is null then 1 else 0 end f from events window w as (partition by user_id order by ts)), s AS (select *, sum(f) over (partition by user_id order by ts range unbounded preceding) k from o) select user_id, min(ts) \"start\", max(ts) + interval 1 hour \"end\", count(*) changes from s group by user_id, k",
        "batch_routing": "WITH o AS (select user_id, event_type, ts, case when ts - lag(ts) over (order by ts) >= interval 10 minute or lag(ts) over (order by ts) is null then 1 else 0 end f from events), s AS (select *, sum(f) over (order by ts range unbounded preceding) k from o) select min(ts) \"start\", count(*) changes, count(distinct user_id) files, case when bool_or(event_type = 'error') then 'flag' else 'rebuild' end \"action\" from s group by k",
    }
