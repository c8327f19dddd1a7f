"""DuckDB statements that say what the catalogue's queries return, written apart from their Spark plans."""

from __future__ import annotations

_NODES = """fx_nodes AS MATERIALIZED (
select 'region_'||r_regionkey::varchar id, r_name label, 'document' file_type, 'geo/regions.md' source_file, 1000000000::bigint+r_regionkey ord from region
union all select 'nation_'||n_nationkey::varchar, n_name, 'document', 'geo/nations.md', 2000000000::bigint+n_nationkey from nation
union all select 'customer_'||c_custkey::varchar, c_name, 'code', 'crm/'||lower(c_mktsegment)||'.py', 3000000000+c_custkey from customer
union all select 'supplier_'||s_suppkey::varchar, s_name||'()', 'code', 'supply/suppliers.go', 4000000000+s_suppkey from supplier
union all select 'part_'||p_partkey::varchar, p_name, 'paper', 'catalog/'||lower(replace(p_brand,'#','_'))||'.pdf', 5000000000+p_partkey from part
union all select 'orders_'||o_orderkey::varchar, 'Order '||o_orderkey::varchar, 'code', case when o_orderstatus='P' then '' else 'sales/orders.rs' end, 6000000000+o_orderkey from orders)"""
_CONF = "case l_returnflag when 'N' then 'EXTRACTED' when 'R' then 'INFERRED' else 'AMBIGUOUS' end"
_RAW = f"""fx_raw AS (
select 'region_'||n_regionkey::varchar s0, 'nation_'||n_nationkey::varchar t0, 'contains' relation, 'EXTRACTED' confidence, 1.0::double weight, 1 kind, n_nationkey::bigint k1, 0 k2 from nation
union all select 'nation_'||c_nationkey::varchar, 'customer_'||c_custkey::varchar, 'contains', 'EXTRACTED', 1.0, 2, c_custkey, 0 from customer
union all select 'nation_'||s_nationkey::varchar, 'supplier_'||s_suppkey::varchar, 'contains', 'EXTRACTED', 1.0, 3, s_suppkey, 0 from supplier
union all select 'customer_'||o_custkey::varchar, 'orders_'||o_orderkey::varchar, 'calls', case o_orderstatus when 'F' then 'EXTRACTED' when 'O' then 'INFERRED' else 'AMBIGUOUS' end, 1.0, 4, o_orderkey, 0 from orders
union all select 'orders_'||l_orderkey::varchar, 'part_'||l_partkey::varchar, 'uses', {_CONF}, l_quantity, 5, l_orderkey, l_linenumber from lineitem
union all select 'supplier_'||l_suppkey::varchar, 'part_'||l_partkey::varchar, case when l_linestatus='F' then 'semantically_similar_to' else 'uses' end, {_CONF}, l_quantity, 6, l_orderkey, l_linenumber from lineitem)"""
_EDGES = """fx_placed AS (select r.*, a.ord ao, b.ord bo from fx_raw r join fx_nodes a on a.id = r.s0 join fx_nodes b on b.id = r.t0),
fx_turned AS (select case when ao > bo then t0 else s0 end source, case when ao > bo then s0 else t0 end target, relation, confidence, weight, s0, t0, least(ao, bo) spos, greatest(ao, bo) tpos, kind, k1, k2 from fx_placed),
edges AS MATERIALIZED (select * from fx_turned qualify row_number() over (partition by source, target order by kind desc, k1 desc, k2 desc, relation desc, confidence desc, weight desc) = 1)"""
_COMM = """comm AS MATERIALIZED (
select (200 + r_regionkey)::bigint cid, 'region_'||r_regionkey::varchar node_id from region
union all select n_nationkey::bigint, 'nation_'||n_nationkey::varchar from nation
union all select c_nationkey::bigint, 'customer_'||c_custkey::varchar from customer
union all select s_nationkey::bigint, 'supplier_'||s_suppkey::varchar from supplier
union all select (100 + p_size)::bigint, 'part_'||p_partkey::varchar from part
union all select c_nationkey::bigint, 'orders_'||o_orderkey::varchar from orders join customer on o_custkey = c_custkey)"""
_ENDS = """ends AS MATERIALIZED (select source id, target other, * exclude (source, target) from edges union all select target, source, * exclude (source, target) from edges),
deg AS (select id, count(*) degree from ends group by id),
ranked AS MATERIALIZED (select n.*, coalesce(d.degree, 0) degree from fx_nodes n left join deg d using (id))"""
_BOTH = "half_c AS MATERIALIZED (select e.*, a.cid ca from edges e join comm a on a.node_id = e.source), both_c AS MATERIALIZED (select h.*, b.cid cb from half_c h join comm b on b.node_id = h.target)"
BASE = "WITH " + ",\n".join([_NODES, _RAW, _EDGES, _COMM, _ENDS, _BOTH])


def base_of(p: str) -> str:
    return f"split_part({p}, '/', -1)"


def file_node(p: str = "") -> str:
    """SQL of a file node, for columns with a prefix."""
    label, src, degree = f"{p}label", f"{p}source_file", f"{p}degree"
    return f"({label} <> '' and (({src} <> '' and {base_of(src)} = {label}) or ({label} like '.%()') or ({label} like '%()' and {degree} <= 1)))"


def concept(p: str = "") -> str:
    return f"({p}source_file = '' or not contains({base_of(p + 'source_file')}, '.'))"


STRUCT = "relation in ('imports', 'imports_from', 'contains', 'method')"
RANK = "case confidence when 'AMBIGUOUS' then 0 when 'INFERRED' then 1 else 2 end"
DESC = """one_side AS MATERIALIZED (select e.*, a.label a_label, a.source_file a_source_file, a.degree a_degree from edges e join ranked a on a.id = e.source),
two_sides AS MATERIALIZED (select e.*, b.label b_label, b.source_file b_source_file, b.degree b_degree from one_side e join ranked b on b.id = e.target),
one_cid AS MATERIALIZED (select e.*, x.cid a_cid from two_sides e left join comm x on x.node_id = e.source),
described AS MATERIALIZED (select e.source, e.target, relation, confidence, s0, spos, tpos, a_label, a_source_file, a_degree, b_label, b_source_file, b_degree, a_cid, y.cid b_cid from one_cid e left join comm y on y.node_id = e.target)"""


def _cat(p: str) -> str:
    ext = f"lower(split_part({p}, '.', -1))"
    code = ",".join(f"'{x}'" for x in "c cc cpp cs cxx dart ex exs go h hpp java jl js jsx kt kts lua m mjs mm php ps1 py rb rs scala sv svelte svh swift toc ts tsx v vue zig".split())
    return f"case when {ext} in ({code}) then 'code' when {ext} = 'pdf' then 'paper' when {ext} in ('gif','jpeg','jpg','png','svg','webp') then 'image' else 'doc' end"


def _top(p: str) -> str:
    return f"split_part({p}, '/', 1)"


def graph_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    slug = r"lower(regexp_replace(regexp_replace({}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"
    q["graph_normalize"] = BASE + " select source, target, relation, confidence, weight, spos, tpos from edges"
    hand = slug.format("{}")
    q["slug_repair"] = BASE + f""", r AS (select *, upper(s0[1])||lower(replace(s0, '_', ' ')[2:]) hs, case when k1 % 5 = 0 then 'no '||t0 else upper(replace(t0, '_', '--')) end ht from fx_raw where kind in (2, 3)),
m AS (select a.id source, b.id target, r.*, a.ord spos, b.ord tpos from r join fx_nodes a on {hand.format('a.id')} = {hand.format('hs')} join fx_nodes b on {hand.format('b.id')} = {hand.format('ht')})
select source, target, hs src0, ht tgt0, relation, spos, tpos from m qualify row_number() over (partition by source, target order by kind desc, k1 desc) = 1"""
    q["degree"] = BASE + " select id, degree from deg"
    q["god_nodes"] = BASE + f" select id, label, degree from ranked where not {file_node()} and not {concept()} order by degree desc, ord limit 10"
    q["god_nodes_query"] = BASE + f", near AS (select id, count(distinct other) degree from ends group by id), r AS (select n.* , coalesce(near.degree, 0) degree from fx_nodes n left join near using (id)) select id, label, degree from r where not ({file_node()} and source_file <> '') and not {concept()} order by degree desc, id limit 10"
    q["degree_variants"] = BASE + " select id, count(*) degree, count(distinct other) neighbours, count(distinct other) filter (where other <> id) proper from ends group by id"
    q["graph_stats"] = BASE + """ select (select count(*) from fx_nodes) nodes, count(*) edges, (select count(distinct cid) from comm) communities,
round(100.0::double * count(*) filter (where confidence not in ('INFERRED','AMBIGUOUS')) / count(*))::bigint extracted_pct, round(100.0::double * count(*) filter (where confidence = 'INFERRED') / count(*))::bigint inferred_pct, round(100.0::double * count(*) filter (where confidence = 'AMBIGUOUS') / count(*))::bigint ambiguous_pct from edges"""
    q["confidence_report"] = BASE + " select count(*) filter (where confidence='EXTRACTED') extracted, count(*) filter (where confidence='INFERRED') inferred, count(*) filter (where confidence='AMBIGUOUS') ambiguous, 0.5::double inferred_score from edges"
    coh = ", inner_e AS (select ca cid, count(*) n from both_c where ca = cb group by ca), sizes AS (select cid, count(*) members from comm group by cid), coh AS (select cid, members, coalesce(n, 0) \"inner\", case when members <= 1 then 1.0::double else round(coalesce(n, 0) / (members::double * (members - 1) / 2) * 100) / 100 end cohesion from sizes left join inner_e using (cid))"
    q["cohesion"] = BASE + coh + ' select cid, members, "inner", cohesion from coh'
    q["community_members"] = BASE + " select cid, label, source_file, id from comm join fx_nodes on id = node_id where cid = 7"
    q["community_sizes_thin"] = BASE + f" select cid, count(*) members, count(*) filter (where not {file_node()}) proper, count(*) filter (where not {file_node()}) between 1 and 2 thin from ranked join comm on node_id = id group by cid"
    q["inter_community"] = BASE + " select least(ca, cb) c1, greatest(ca, cb) c2, count(*) edges, sum(weight) weight from both_c where ca <> cb group by all"
    q["layout_pair_weights"] = BASE + " select least(ca, cb) c1, greatest(ca, cb) c2, sum(weight) weight from both_c group by all"
    q["community_bridges"] = BASE + ", r AS (select a.cid, e.id, count(distinct b.cid) filter (where b.cid <> a.cid) reach, count(*) degree from ends e join comm a on a.node_id = e.id join comm b on b.node_id = e.other group by all) select cid, row_number() over (partition by cid order by reach desc, degree desc, id)::int rank, id, reach, degree from r where reach > 0 qualify rank <= 5"
    q["community_overview"] = BASE + """, m AS (select cid, count(*) members from comm group by cid), i AS (select ca cid, count(*) n from both_c where ca = cb group by ca),
x AS (select cid, count(*) n from (select ca cid from both_c where ca <> cb union all select cb from both_c where ca <> cb) group by cid),
t AS (select cid, label, row_number() over (partition by cid order by degree desc, id) rn from ranked join comm on node_id = id),
p AS (select cid, string_agg(label, '; ' order by rn) preview from t where rn <= 3 group by cid)
select m.cid, members, coalesce(i.n, 0) "inner", coalesce(x.n, 0) "cross", coalesce(preview, '') preview from m left join i using (cid) left join x using (cid) left join p using (cid)"""
    q["dominant_confidence"] = BASE + f", n AS (select id, confidence, count(*) edges from ends group by all) select id, confidence, edges from n qualify row_number() over (partition by id order by edges desc, {RANK}, confidence) = 1"
    q["wiki_audit"] = BASE + """, c AS (select a.cid, count(*) filter (where confidence='EXTRACTED') extracted, count(*) filter (where confidence='INFERRED') inferred, count(*) filter (where confidence='AMBIGUOUS') ambiguous, count(*) filter (where b.cid <> a.cid) "cross" from ends e join comm a on a.node_id = e.id left join comm b on b.node_id = e.other group by a.cid),
s AS (select cid, count(distinct source_file) filter (where source_file <> '') sources from fx_nodes join comm on node_id = id group by cid)
select cid, coalesce(extracted, 0) extracted, coalesce(inferred, 0) inferred, coalesce(ambiguous, 0) ambiguous, coalesce("cross", 0) "cross", sources from s left join c using (cid)"""
    q["modularity_given"] = BASE + """, d AS (select cid, sum(degree) d from deg join comm on node_id = id group by cid), l AS (select ca cid, count(*) l from both_c where ca = cb group by ca), m AS (select count(*)::double m from edges)
select max(m)::bigint edges, sum(coalesce(l, 0))::bigint "within", round(sum(coalesce(l, 0) / m - (d / (2 * m)) * (d / (2 * m))), 9) modularity from d left join l using (cid), m"""
    words = ["order", "customer"]
    score = " + ".join(f"contains(lower(label), '{w}')::int * 2 + contains(lower(source_file), '{w}')::int" for w in ("supplier", "crm"))
    q["search_scores"] = BASE + f", s AS (select id, {score} score from fx_nodes) select id, score from s where score > 0"
    balls = ", near AS (select distinct id, other from ends where id <> other), l0 AS (select 'nation_3' id, 0 level, null::varchar parent)"
    for k in (1, 2, 3):
        before = " union all ".join(f"select * from l{j}" for j in range(k))
        balls += f", s{k} AS ({before}), l{k} AS (select other id, {k} level, min(near.id) parent from near join l{k - 1} f on f.id = near.id where other not in (select id from s{k}) group by other)"
        q[f"bfs_ball_d{k}"] = BASE + balls + " " + " union all ".join(f"select id, level, parent from l{j}" for j in range(k + 1))
    q["shortest_path_hops"] = BASE + balls + " select level hops from (" + " union all ".join(f"select * from l{j}" for j in range(4)) + ") where id = 'part_7'"
    q["explain_neighbors"] = BASE + ", t AS (select other id, relation, confidence from ends where id = 'supplier_3') select id, label, relation, confidence, degree from t join ranked using (id) order by degree desc, id limit 20"
    q["neighbors_filtered"] = BASE + ", t AS (select other id, relation, confidence from ends where id = 'supplier_3' and contains(lower(relation), 'semantic')) select id, label, relation, confidence, degree from t join ranked using (id)"
    cond = f"not {STRUCT} and a_source_file <> '' and b_source_file <> '' and a_source_file <> b_source_file and not {file_node('a_')} and not {file_node('b_')} and not {concept('a_')} and not {concept('b_')}"
    q["surprises"] = BASE + ", " + DESC + f""", f AS (select *, {_cat('a_source_file')} ka, {_cat('b_source_file')} kb, {_top('a_source_file')} <> {_top('b_source_file')} folders, coalesce(a_cid <> b_cid, false) apart, relation = 'semantically_similar_to' alike, least(a_degree, b_degree) <= 2 and greatest(a_degree, b_degree) >= 5 hub from described where {cond}),
s AS (select *, 3 - ({RANK}) + case when ka <> kb then 2 else 0 end + case when folders then 2 else 0 end + apart::int base from f),
t AS (select *, (case when alike then round(base * 1.5)::int else base end + hub::int)::int score from s),
u AS (select *, concat_ws('; ', case when confidence in ('AMBIGUOUS','INFERRED') then lower(confidence)||' connection - not explicitly stated in source' end, case when ka <> kb then 'crosses file types ('||ka||' ↔ '||kb||')' end, case when folders then 'connects across different repos/directories' end, case when apart then 'bridges separate communities' end, case when alike then 'semantically similar concepts with no structural link' end, case when hub then 'peripheral node `'||(case when a_degree <= 2 then a_label else b_label end)||'` unexpectedly reaches hub `'||(case when a_degree <= 2 then b_label else a_label end)||'`' end) why from t order by score desc, spos, tpos limit 5)
select row_number() over (order by score desc, spos, tpos)::int rank, case when s0 = target then b_label else a_label end source, case when s0 = target then a_label else b_label end target, relation, confidence, score, case when why = '' then 'cross-file semantic connection' else why end why from u"""
    q["cross_community_surprises"] = BASE + ", " + DESC + f""", f AS (select *, {RANK} r from described where not {STRUCT} and a_cid <> b_cid and not {file_node('a_')} and not {file_node('b_')} qualify row_number() over (partition by least(a_cid, b_cid), greatest(a_cid, b_cid) order by {RANK}, spos, tpos) = 1), t AS (select * from f order by r, spos, tpos limit 5)
select row_number() over (order by r, spos, tpos)::int rank, case when s0 = target then b_label else a_label end source, case when s0 = target then a_label else b_label end target, relation, confidence, 'Bridges community '||a_cid||' → community '||b_cid why from t"""
    q["questions_ambiguous"] = BASE + """, f AS (select * from edges where confidence = 'AMBIGUOUS' order by spos, tpos limit 7) select row_number() over (order by f.spos, f.tpos)::int rank, 'ambiguous_edge' type, 'What is the exact relationship between `'||a.label||'` and `'||b.label||'`?' question, 'Edge tagged AMBIGUOUS (relation: '||relation||') - confidence is low.' why from f join fx_nodes a on a.id = source join fx_nodes b on b.id = target"""
    q["questions_inferred"] = BASE + f""", best AS (select * from ranked where not {file_node()} order by degree desc, ord limit 5), i AS (select b.id, b.label, b.degree, b.ord, e.other, row_number() over (partition by b.id order by spos, tpos, other) k, count(*) over (partition by b.id) n from best b join ends e on e.id = b.id where confidence = 'INFERRED'),
t AS (select i.id, i.label, i.degree, i.ord, n, max(o.label) filter (where k = 1) x, max(o.label) filter (where k = 2) y from i join fx_nodes o on o.id = other where n >= 2 group by all)
select row_number() over (order by degree desc, ord)::int rank, 'verify_inferred' type, 'Are the '||n||' inferred relationships involving `'||label||'` (e.g. with `'||x||'` and `'||y||'`) actually correct?' question, '`'||label||'` has '||n||' INFERRED edges - model-reasoned connections that need verification.' why from t"""
    q["questions_isolated"] = BASE + f""", n AS (select * from ranked where degree <= 1 and not {file_node()} and not {concept()}), f AS (select * from n order by ord limit 3)
select 1::int rank, 'isolated_nodes' type, 'What connects '||string_agg('`'||label||'`', ', ' order by ord)||' to the rest of the system?' question, (select count(*) from n)||' weakly-connected nodes found - possible documentation gaps or missing edges.' why from f having count(*) > 0"""
    q["questions_low_cohesion"] = BASE + coh + " select cid, 'low_cohesion' type, 'Should `Community '||cid||'` be split into smaller, more focused modules?' question, 'Cohesion score '||cohesion||' - nodes in this community are weakly interconnected.' why from coh where cohesion < 0.15 and members >= 5"
    # The old graph of the diffs: without orders of status F, and with edges of parts of size 1 as they were before.
    old = ", oldn AS (select * from fx_nodes where id not in (select 'orders_'||o_orderkey::varchar from orders where o_orderstatus = 'F')), newn AS (select * from fx_nodes where file_type <> 'document'), olde AS (select * from edges where source in (select id from oldn) and target in (select id from oldn)), newe AS (select * from edges where source in (select id from newn) and target in (select id from newn))"
    dn = ", dn AS (select 'new' change, id, label from newn where id not in (select id from oldn) union all select 'removed', id, label from oldn where id not in (select id from newn))"
    de = ", de AS (select 'new' change, source, target, relation, confidence from newe n where not exists (select 1 from olde o where o.source = n.source and o.target = n.target and o.relation = n.relation) union all select 'removed', source, target, relation, confidence from olde n where not exists (select 1 from newe o where o.source = n.source and o.target = n.target and o.relation = n.relation))"
    q["graph_diff_nodes"] = BASE + old + dn + " select * from dn"
    q["graph_diff_edges"] = BASE + old + de + " select * from de"
    q["graph_diff_summary"] = BASE + old + dn + de + """, c AS (select (select count(*) from dn where change='new') a, (select count(*) from de where change='new') b, (select count(*) from dn where change='removed') c, (select count(*) from de where change='removed') d)
select a new_nodes, b new_edges, c removed_nodes, d removed_edges, coalesce(nullif(concat_ws(', ', case when a > 0 then a||' new node'||if(a=1,'','s') end, case when b > 0 then b||' new edge'||if(b=1,'','s') end, case when c > 0 then c||' node'||if(c=1,'','s')||' removed' end, case when d > 0 then d||' edge'||if(d=1,'','s')||' removed' end), ''), 'no changes') summary from c"""
    q["validate"] = BASE + """, n AS (select ord, id, case when id like '%\\_7' escape '\\' then 'video' else file_type end ft, case when id like 'part\\_%9' escape '\\' then null else label end label from fx_nodes where id not like 'customer\\_1%' escape '\\'),
e AS (select (kind::bigint * 1000000000000 + k1 * 100 + k2) ord, s0, t0, case when k2 = 3 then 'CERTAIN' else confidence end confidence from fx_raw)
select 'node' part, ord "position", id, 'missing label' error from n where label is null union all select 'node', ord, id, 'invalid file_type' from n where ft not in ('code','document','image','paper','rationale')
union all select 'edge', ord, null, 'invalid confidence' from e where confidence not in ('EXTRACTED','INFERRED','AMBIGUOUS')
union all select 'edge', ord, null, 'source is no node' from e where s0 not in (select id from n) union all select 'edge', ord, null, 'target is no node' from e where t0 not in (select id from n)"""
    q["merge_graphs"] = BASE + ", a AS (select *, 0 part, 'east' repo from fx_nodes where id like 'customer%' or id like 'nation%'), b AS (select id, upper(label) label, file_type, source_file, ord, 1 part, 'west' repo from fx_nodes where id not like 'customer%'), u AS (select * from a union all select * from b) select id, label, file_type, source_file, ord, repo from u qualify row_number() over (partition by id order by part, ord) = 1"
    q["label_dedup"] = BASE + f", k AS (select id, ord, {slug.format('label')} s from fx_nodes), g AS (select *, case when s <> '' then 's'||s else 'i'||id end key from k), o AS (select *, ord = min(ord) over (partition by key) or not contains(id, '_chunk') ok from g), b AS (select key, arg_min(id, (octet_length(encode(id)), ord)) filter (where ok) keep from o group by key) select id, keep from o join b using (key)"
    q["preserved_semantics"] = BASE + ", code AS (select id from fx_nodes where file_type = 'code') select source, target, relation, confidence from edges where confidence in ('INFERRED','AMBIGUOUS') or (source not in (select id from code) and target not in (select id from code))"
    return q
