"""Queries of exports and iterative operators on the derived graph, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import PALETTE
from weftgraph.operators import analyze, centrality, cluster, export, query
from weftgraph.plans.oracle import BASE
from weftgraph.sources.derived import graph, raw_nodes

VAULT = r"""WITH n AS (%s), b AS (select id, ord, trim(regexp_replace(regexp_replace(label, '\r\n|\r|\n', ' ', 'g'), '[\\/*?:"<>|#^\[\]]', '', 'g')) base from n),
k AS (select id, case when base = '' then 'unnamed' else base end base, row_number() over (partition by base order by ord, id) - 1 k from b)
select id, case when k = 0 then base else base||'_'||k end name from k"""


def _of(f):
    return lambda spark, sf_dir: f(graph(spark, sf_dir))


def betweenness_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's betweenness from 100 roots."""
    return centrality.node_betweenness(graph(spark, sf_dir), 100)


def betweenness_edges_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge's betweenness from 100 roots."""
    return centrality.edge_betweenness(graph(spark, sf_dir), 100)


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.communities(graph(spark, sf_dir))


def vault_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.vault_names(raw_nodes(spark, sf_dir))


def token_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.benchmark(graph(spark, sf_dir), ["which supplier serves region europe", "customer building orders"])


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.questions(graph(spark, sf_dir))


def queries():
    return {
        "node_link_nodes": _of(export.node_link_nodes),
        "node_link_links": _of(export.node_link_links),
        "cypher_nodes": _of(export.cypher_nodes),
        "cypher_edges": _of(export.cypher_edges),
        "graphml_rows": _of(export.graphml),
        "vault_filenames": vault_filenames,
        "canvas_grid": _of(export.canvas_grid),
        "canvas_edges": _of(export.canvas_edges),
        "wiki_articles": _of(export.wiki_articles),
        "svg_nodes": _of(export.svg_nodes),
        "betweenness_edges_sampled": betweenness_edges_sampled,
        "betweenness_sampled": betweenness_sampled,
        "communities": communities,
        "questions": questions,
        "token_benchmark": token_benchmark,
    }


def sql():
    nodes = BASE + " select * from fx_nodes"
    q = lambda c: f"''''||replace(replace({c}, '\\', '\\\\'), '''', '\\''')||''''"
    x = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
    colours = "[" + ", ".join(f"'{c}'" for c in PALETTE) + "]"
    parts, rows = [], []
    for k, words in enumerate((["which", "supplier", "serves", "region", "europe"], ["customer", "building", "orders"])):
        score = " + ".join(f"contains(lower(label), '{w}')::int * 2 + contains(lower(source_file), '{w}')::int" for w in words)
        parts.append(f"q{k}_0 AS (select id, null::varchar parent from (select id, {score} score from fx_nodes) where score > 0 order by score desc, id desc limit 3)")
        for level in (1, 2, 3):
            before = " union all ".join(f"select id from q{k}_{j}" for j in range(level))
            parts.append(f"q{k}_{level} AS MATERIALIZED (select other id, min(near.id) parent from near join q{k}_{level - 1} f on f.id = near.id where other not in ({before}) group by other)")
        seen = " union all ".join(f"select * from q{k}_{j}" for j in range(4))
        parts.append(f"""q{k} AS MATERIALIZED ({seen}), b{k} AS (select sum(octet_length(encode(line)) + 1) b from (
select 'NODE '||label||' [src='||source_file||' loc= community='||coalesce(cid::varchar, '')||']' line from q{k} join fx_nodes using (id) left join comm on node_id = id
union all select 'EDGE '||a.label||' --'||e.relation||' ['||e.confidence||']--> '||b.label from q{k} v join fx_nodes a on a.id = v.parent join fx_nodes b on b.id = v.id join edges e on e.source = case when a.ord < b.ord then a.id else b.id end and e.target = case when a.ord < b.ord then b.id else a.id end))""")
        question = ("which supplier serves region europe", "customer building orders")[k]
        rows.append(f"select '{question}' question, corpus corpus_tokens, greatest(1, (b::bigint - 1) // 4) query_tokens from b{k}, c where b > 0")
    tokens = BASE + ", near AS MATERIALIZED (select distinct id, other from ends where id <> other), c AS (select (count(*) * 50) * 100 // 75 corpus from fx_nodes), " + ",\n".join(parts) + ", r AS (" + " union all ".join(rows) + ") select question, corpus_tokens::int corpus_tokens, query_tokens::bigint query_tokens, round(corpus_tokens::double / query_tokens * 10) / 10 reduction from r"
    return {
        "node_link_nodes": BASE + " select id, label, lower(label) norm_label, file_type, source_file, cid community from fx_nodes left join comm on node_id = id",
        "node_link_links": BASE + " select source, target, relation, confidence, round(weight, 6) weight, case confidence when 'INFERRED' then 0.5 when 'AMBIGUOUS' then 0.2 else 1.0 end::double confidence_score from edges",
        "cypher_nodes": BASE + f" select id, 'MERGE (n:'||file_type||' {{id: '||{q('id')}||'}}) SET n += {{file_type: '||{q('file_type')}||', id: '||{q('id')}||', label: '||{q('label')}||', source_file: '||{q('source_file')}||'}};' line from fx_nodes",
        "cypher_edges": BASE + f" select source, target, 'MATCH (a {{id: '||{q('source')}||'}}), (b {{id: '||{q('target')}||'}}) MERGE (a)-[r:'||upper(relation)||']->(b) SET r += {{confidence: '||{q('confidence')}||', relation: '||{q('relation')}||', weight: '||weight::varchar||'}};' line from edges",
        "graphml_rows": BASE + f""" select 'node' part, id "key", '<node id="'||{x('id')}||'"><data key="label">'||{x('label')}||'</data><data key="source_file">'||{x('source_file')}||'</data><data key="file_type">'||{x('file_type')}||'</data><data key="community">'||coalesce(cid, -1)||'</data></node>' "value" from fx_nodes left join comm on node_id = id
union all select 'edge', source||'|'||target, '<edge source="'||{x('source')}||'" target="'||{x('target')}||'"><data key="relation">'||{x('relation')}||'</data><data key="confidence">'||{x('confidence')}||'</data></edge>' from edges""",
        "vault_filenames": VAULT % nodes,
        "canvas_grid": BASE + """, s AS (select cid, count(*) n, row_number() over (order by count(*) desc, cid) - 1 k from comm group by cid), c AS (select ceil(sqrt(count(*)))::bigint cols from s), b AS (select cid, k % cols col, k // cols "row", greatest(400, ceil(n / 3.0)::bigint * 100 + 120) height from s, c),
r AS (select "row", max(height) h from b group by "row"), y AS (select "row", sum(h + 80) over (order by "row") - h - 80 y from r)
select cid, col, "row", col * 680 x, y, 600 width, height from b join y using ("row")""",
        "canvas_edges": BASE + " select source, target, relation, weight from edges order by weight desc, spos, tpos limit 200",
        "wiki_articles": BASE + """, a AS (select cid, 'node' part, row_number() over (partition by cid order by degree desc, id)::int rank, id "value", degree n from ranked join comm on node_id = id qualify rank <= 25),
h AS MATERIALIZED (select a.cid, e.other from ends e join comm a on a.node_id = e.id), f AS MATERIALIZED (select h.cid, b.cid far from h join comm b on b.node_id = h.other), x AS (select cid, far, count(*) n from f where cid <> far group by all)
select * from a union all (select cid, 'link', row_number() over (partition by cid order by n desc, far)::int rank, far::varchar, n from x qualify rank <= 12)""",
        "svg_nodes": BASE + f", a AS (select r.*, cid, row_number() over (order by ord, id) - 1 k, max(degree) over () most from ranked r left join comm on node_id = r.id) select id, k % 40 * 120 x, k // 40 * 120 y, round(18.0::double + degree * 24.0::double / greatest(most, 1), 1) r, {colours}[(coalesce(cid, 0) % 10 + 1)::int] fill from a",
        "token_benchmark": tokens,
    }
