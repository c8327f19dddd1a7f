"""Defined cases: repeated ids, very long texts, ties, clashing columns and empty tables, for every operator and stage; and two more brute-force versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import collinear, decontaminate, licenses, ngram_jaccard, packing, pii, suffix_family, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=9000):
    r = random.Random(seed)
    return ["w" + str(r.randrange(vocabulary)) for _ in range(n)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Repeated ids with equal and with other texts, equal texts, a text of 300,000 words, nulls, and columns named like the operators' own."""
    p, long = words(80, 1), words(300_000, 2, 10**6)
    rows = [(1, " ".join(p)), (1, " ".join(p)), (2, " ".join(p)), (3, " ".join(long + p)), (3, "zz " + " ".join(p)), (4, " ".join(long[5000:5200])), (5, ""), (6, None), (None, " ".join(p)), (7, "short")]
    docs = spark.createDataFrame([(i, t, "en", "hot", len(t or "")) for i, t in rows], DOCS)
    for name in ("bucket", "block", "data", "anchors", "part", "size", "digest", "score", "start", "kept_id", "gone_id", "label", "tokens"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs.repartition(3).checkpoint()


def test_passages_and_repeats_of_awkward_rows(spark, awkward):
    rows = collinear.fuzzy_passages(awkward).collect()
    pairs = {(r["match_doc"], r["doc_id"]) for r in rows}
    assert (1, 2) in pairs and (3, 4) in pairs and all(r["match_doc"] < r["doc_id"] for r in rows)
    assert len({tuple(r) for r in rows}) == len(rows)
    spans = {(r["doc_id"], r["match_doc"], r["length"]) for r in suffix_family.long_repeats(awkward).collect()}
    assert (2, 1, 80) in spans and (4, 3, 200) in spans and not any(d in (1, 5, 6, 7, None) for d, _, _ in spans)


def test_similar_documents_of_awkward_rows(spark, awkward):
    rows = {r["doc_id"]: r for r in ngram_jaccard.similar_documents(awkward).collect()}
    assert rows[2]["set_id"] == 1 == rows[1]["set_id"] and rows[1]["class_id"] == 1 and None not in rows
    kept = ngram_jaccard.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids.count("1") == 2 and "2" not in ids and {"None", "5", "6", "7"} <= set(ids)


def test_scans_of_awkward_rows(spark, awkward):
    lic = awkward.withColumn("text", F.when(F.col("doc_id") == 3, F.concat("text", F.lit("\nLicensed under the MIT License.\n"))).otherwise(F.col("text")))
    assert [(r["doc_id"], r["license_id"]) for r in licenses.scan(lic).collect()] == [(3, "MIT")] * 2
    mail = awkward.withColumn("text", F.when(F.col("doc_id") == 3, F.concat("text", F.lit(" write to a.b@example.org now"))).otherwise(F.col("text")))
    found = pii.personal_spans(mail).filter("kind = 'email'").collect()
    assert len(found) == 2 and {r["doc_id"] for r in found} == {3}
    red = pii.redacted(mail)
    assert red.columns == mail.columns and red.filter("text like '%[EMAIL]%'").count() == 2 and red.count() == mail.count()


def test_contamination_of_awkward_rows(spark, awkward):
    long = words(300_000, 2, 10**6)
    item = " ".join(long[250_000:250_030])
    bench = spark.createDataFrame([(9, item), (9, item), (8, "short"), (7, "12 + 7 * 3 - 45 / 9 + 6 = 1 2 3"), (None, item), (6, None)], "item_id long, text string").withColumn("text2", F.lit(1)).withColumn("doc_id", F.lit("x"))
    more = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(20, "so 12 + 7 * 3 - 45 / 9 + 6 = 1 2 3 it is"), (21, "a short one"), (22, "so 12 + 7 * 3 - 45 / 9 + 8 = 4 5 6 it is")], "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminations(more, bench).collect()}
    assert set(got) == {(3, 9), (7, 8), (20, 7)} and got[3, 9]["start"] == 250_000 and got[3, 9]["exact"]
    kept = decontaminate.without_leaks(awkward, bench)
    assert kept.columns == awkward.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "3", "4", "5", "6", "None"]


def brute(docs, items):
    """(document, item) pairs by all diagonals, window after window."""
    t, b = decontaminate.Template(pa.array(docs, pa.large_string())), decontaminate.Template(pa.array(items, pa.large_string()))
    cut = lambda x, i: (x.code[x.first[i] : x.first[i + 1]].tolist(), x.value[x.first[i] : x.first[i + 1]].tolist())
    out = set()
    for d in range(len(docs)):
        dc, dv = cut(t, d)
        for k in range(len(items)):
            ic, iv = cut(b, k)
            n = len(ic)
            if n < decontaminate.SHORTEST:
                if n and iv == dv:
                    out.add((d, k))
                continue
            w = min(n, decontaminate.WIDTH)
            for shift in range(-n, len(dc)):
                at = set()
                for q in range(n - w + 1):
                    p = q + shift
                    if 0 <= p and p + w <= len(dc):
                        told = sum(c > 0x33 for c in ic[q : q + w]) * 2 >= w
                        if (ic[q : q + w] == dc[p : p + w]) if told else (iv[q : q + w] == dv[p : p + w]):
                            at |= set(range(q, q + w))
                if at and (len(at) >= max(1, min(n, decontaminate.COVER * n)) or len(at) >= decontaminate.LEAST):
                    pairs = {(iv[q], dv[q + shift]) for q in at if ic[q] <= 0x33}
                    if len(pairs) == len({a for a, _ in pairs}):
                        out.add((d, k))
    return out


def test_contamination_against_all_diagonals():
    r = random.Random(6)
    vocabulary = ["apples", "are", "sold", "by", "the", "Alice", "Bob", "12", "7", "kg", "and", "then", "Mary", "3.5", "in", "shops", "when", "red"]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.choice([2, 5, 7, 9, 14, 20]))) for _ in range(40)]
    docs = []
    for k in range(120):
        base = items[k % 40].split()
        change = {x: r.choice(vocabulary) for x in set(base) if x in ("Alice", "Bob", "Mary", "12", "7", "3.5")} if k % 3 == 0 else {}
        part = base if k % 4 else base[: len(base) // 2]
        docs.append(" ".join([r.choice(vocabulary) for _ in range(r.randrange(5))] + [change.get(x, x) for x in part] + [r.choice(vocabulary) for _ in range(r.randrange(4))]) if k % 5 else " ".join(base))
    found = decontaminate.Items(list(range(40)), items).find(pa.array(docs, pa.large_string()))
    want = brute(docs, items)
    assert {(f[0], f[1]) for f in found} == want and len(want) > 60


def test_scores_are_those_of_plain_windows():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS) * 20, -0.5, 0.5)
    texts = [" ".join(words(n, n, 40)) for n in (1, 31, 32, 33, 100)] + ["", "é ñandú日本 x", "a"]

    def plain(text):
        w, best = text.lower().split(), 0.0
        for s in range(0, len(w), toxicity.WINDOW):
            grams = np.concatenate([toxicity.subwords(pa.array([x], pa.large_string()))[0] for x in sorted(set(w[s : s + toxicity.WINDOW]))])
            if len(grams):
                best = max(best, 1 / (1 + math.exp(-(model.bias + model.weight[grams].sum() / (len(grams) + toxicity.SMOOTH)))))
        return best

    got = model.score(pa.array([*texts, None], pa.large_string()))
    assert np.allclose(got[:-1], [plain(t) for t in texts]) and got[-1] == 0


def test_thresholds_over_nine_tenths_stay(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: (np.zeros(toxicity.BUCKETS), 0.0))
    scores = iter([np.array([0.99, 0.95, 0.94, 0.2] * 50)])
    monkeypatch.setattr(toxicity.Model, "score", lambda self, column: next(scores)[: len(column)])
    rows = [(i, f"t{i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).orderBy("doc_id").limit(200)
    ids = [r["doc_id"] for r in held.collect()]
    labels = spark.createDataFrame([(d, int(ids.index(d) % 4 < 2) if d in ids else d % 2) for d, _ in rows], "doc_id long, toxic int")
    assert 0.94 < toxicity.fit(docs, labels).threshold < 0.99


def test_pipeline_of_empty_and_of_awkward_tables(spark, awkward, tmp_path):
    none = {"documents": DOCS, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, schema in none.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
        (awkward if name == "documents" else spark.createDataFrame([], schema)).write.parquet(str(tmp_path / "odd" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    docs = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "odd"))
        assert out.columns == docs.columns and {5, 6, None} <= {r["doc_id"] for r in out.collect()}
    ids = {d for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect() for d in r["doc_ids"]}
    assert {1, 4, 7} <= ids and 2 not in ids and None not in ids
    assert packing.token_matrices(docs).count() > 0
