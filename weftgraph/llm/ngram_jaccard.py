"""Operator 3: exact Jaccard join on word n-gram sets, as a blocked sparse matrix product.

The document by n-gram incidence matrix is cut into column blocks by n-gram
hash.  Each block is sorted once, which gives, for every document, how many of
its n-grams any other document shares, and under which anchors (blocks.links).
Size bounds then discard what can't reach the threshold: a pair with Jaccard
>= t shares at least t * |A| n-grams, and at least t / (1 + t) * (|A| + |B|).
So a document with fewer shared n-grams than t * |A| has no partner, and it may
leave the anchors with the smallest counts as long as their sum stays under
t / (1 + t) * |A|: a pair that neither side meets in a kept anchor would share
less than the bound.  Documents that keep an anchor meet there, and the product
of their incidence rows, tile by tile, gives the exact overlaps.

``similar_documents`` (the query): (doc_id, class_id, set_id, links), a row for
each document that has a partner.  set_id is the smallest id with an equal
n-gram set, links the number of other sets with Jaccard >= t, each counted, and
class_id the smallest id of all that hang together by such pairs.  Rows follow
the documents, however large a group of copies or near copies is.

``jaccard_join``: (doc_a, doc_b, overlap, size_a, size_b, jaccard), doc_a < doc_b.
Documents with equal n-gram sets are collapsed: the smallest id stands for the
set in all pairs, and each other member appears once, with it, at 1.0.  This
loses no information (the pairs of a class are those of its representative).

Equal sets are found by 128 bits of digest and one aggregation, before texts
move, so thousands of exact copies never meet in a task.  An anchor that many
different documents keep is compared part by part (blocks.gather).

Defined cases: null ids or texts and texts without words make no pair; a text
of fewer than n words has one n-gram, itself; of rows that repeat an id the one
with the smallest set digest counts; other columns are ignored; an empty table
gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import blocks as B
from weftgraph.llm import kernels as K
from weftgraph.operators.cluster import connected
from weftgraph.session import shared_checkpoints

N, THRESHOLD, NEAR_COPY = 5, 0.3, 0.5
ROWS, COLUMNS = 1024, 8192
SCHEMA = "doc_a long, doc_b long, overlap long, size_a long, size_b long, jaccard double"


def _keep(t: float):
    eps = 1e-9

    def keep(doc, anchor, n, size):
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        start = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        total = np.add.reduceat(n, start)[group]
        before = np.cumsum(n) - n
        rest = total - (before - before[start][group])  # this anchor's and all smaller counts
        return (total >= t * size - eps) & (rest >= t / (1 + t) * size - eps)

    return keep


def product(ids: np.ndarray, sets: list[np.ndarray], t: float):
    """All pairs of equal-free sorted sets with Jaccard >= t, as (i, j, overlap) with i < j.

    Columns held by one set only can't add to an overlap and are left out of
    the tiles; set sizes count them.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    use = count[column] > 1
    row, column = row[use], column[use]
    if not len(row):
        return (np.zeros(0, np.int64),) * 3
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(size, kind="stable")  # rows by size, so that far sizes make whole tiles needless
    rank = np.empty(len(size), np.int64)
    rank[order] = np.arange(len(size))
    row, ordered = rank[row], size[order]
    at = np.argsort(row, kind="stable")
    row, column = row[at], column[at]
    width = int(column.max()) + 1
    out = []
    edges = np.searchsorted(row, np.arange(0, len(size) + ROWS, ROWS))
    parts = [(s, row[edges[k] : edges[k + 1]] - s, column[edges[k] : edges[k + 1]]) for k, s in enumerate(range(0, len(size), ROWS))]
    for p, (s1, r1, c1) in enumerate(parts):
        n1 = min(ROWS, len(size) - s1)
        for s2, r2, c2 in parts[p:]:
            n2 = min(ROWS, len(size) - s2)
            if ordered[s1 + n1 - 1] < t * ordered[s2] - 1e-9:
                break
            total = np.zeros((n1, n2), np.float32)
            for c in range(0, width, COLUMNS):
                in1, in2 = (c1 >= c) & (c1 < c + COLUMNS), (c2 >= c) & (c2 < c + COLUMNS)
                if in1.any() and in2.any():
                    w = min(COLUMNS, width - c)
                    a = np.zeros((n1, w), np.float32)
                    a[r1[in1], c1[in1] - c] = 1
                    if s1 == s2:
                        b = a
                    else:
                        b = np.zeros((n2, w), np.float32)
                        b[r2[in2], c2[in2] - c] = 1
                    total += a @ b.T
            both = ordered[s1 : s1 + n1, None] + ordered[None, s2 : s2 + n2]
            hit = (total > 0) & (total * (1 + t) >= t * both - 1e-6)
            if s1 == s2:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            out.append((order[i + s1], order[j + s2], total[i, j].astype(np.int64)))
    i, j, o = (np.concatenate(x) for x in zip(*out))
    return np.minimum(i, j), np.maximum(i, j), o


def _small(a: np.ndarray, b: np.ndarray, t: float):
    o = len(np.intersect1d(a, b, assume_unique=True))
    return o if o and o >= t * (len(a) + len(b) - o) - 1e-9 else 0


def _digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed integers; any order gives the same."""
    with np.errstate(over="ignore"):
        a = np.array([K.mix(grams).sum(dtype=np.uint64), K.mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
    return tuple(a.view(np.int64).tolist())


def _sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted n-gram set of each row."""
    out: list[np.ndarray] = []
    for _, piece in K.pieces(column):
        h, row, _ = K.ngrams(K.Words(piece), n)
        cut = np.searchsorted(row, np.arange(len(piece) + 1))
        out += [K.distinct(h[cut[k] : cut[k + 1]]) for k in range(len(piece))]
    return out


def digests(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, d1, d2, size) of the n-gram set of each document with words; the smallest of a repeated id."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(d, *_digest(s), len(s)) for d, s in zip(ids, _sets(batch.column(1), n)) if len(s)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "d1", "d2", "size"])

    made = docs.mapInArrow(run, "doc_id long, d1 long, d2 long, size long")
    return made.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "size")).alias("d")).select("doc_id", "d.*")


def _tables(table: pa.Table, n: int):
    """(ids, sets, kept anchors, part) by row, ids ascending and unique."""
    table = table.sort_by("doc_id")
    ids, sets = table.column("doc_id").to_numpy(), _sets(B.one(table.column("text")), n)
    take = list(range(len(ids)))
    if len(np.unique(ids)) < len(ids):
        best: dict[int, int] = {}
        for k, d in enumerate(ids.tolist()):
            if len(sets[k]) and (d not in best or (_digest(sets[k]), k) < (_digest(sets[best[d]]), best[d])):
                best[d] = k
        take = sorted(best.values())
    table = table.take(pa.array(take, pa.int64()))
    return ids[take], [sets[k] for k in take], table


def compare(table: pa.Table, n: int, t: float, pairs: bool) -> pa.Table:
    """Pairs of a cell, or for each document and anchor its number of pairs and the smallest id that they reach."""
    ids, sets, table = _tables(table, n)
    mine, at = B.lists(table.column("mine"))
    keeps, kat = B.lists(table.column("anchors"))
    keep = [set(keeps[kat[k] : kat[k + 1]].tolist()) for k in range(len(ids))]
    part, cross = table.column("part").to_numpy(), len(ids) > 0 and table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
    member = np.repeat(np.arange(len(ids)), np.diff(at))
    order = np.lexsort((member, mine))
    mine, member = mine[order], member[order]
    only = np.array([len(k) == 1 for k in keep], bool)
    out: list[np.ndarray] = []
    for s, e in zip(*B._runs(mine)):
        anchor, docs = int(mine[s]), np.array([m for m in member[s:e].tolist() if len(sets[m])], np.int64)
        if len(docs) < 2:
            continue
        if len(docs) == 2:
            o = _small(sets[docs[0]], sets[docs[1]], t)
            i, j, o = (np.array(x, np.int64) for x in (([0], [1], [o]) if o else ([], [], [])))
        else:
            i, j, o = product(ids[docs], [sets[d] for d in docs], t)
        a, b = docs[i], docs[j]  # ids ascend
        if cross:
            a, b, o = (x[part[docs[i]] != part[docs[j]]] for x in (a, b, o))
        once = only[a] | only[b]  # one common anchor, this one
        for k in np.flatnonzero(~once):
            once[k] = min(keep[a[k]] & keep[b[k]]) == anchor
        a, b, o = a[once], b[once], o[once]
        za, zb = (np.array([len(sets[x]) for x in y], np.int64) for y in (a, b))
        ok = o >= t * (za + zb - o) - 1e-9
        if pairs:
            out.append(np.stack([ids[a], ids[b], o, za, zb])[:, ok])
        elif ok.any():
            seen, count = np.unique(np.concatenate([a[ok], b[ok]]), return_counts=True)
            out.append(np.stack([ids[seen], _roots(seen, a[ok], b[ok], ids), count]))
    flat = np.concatenate(out, axis=1) if out else np.zeros((5 if pairs else 3, 0), np.int64)
    if not pairs:
        return pa.table(dict(zip(("doc_id", "other", "links"), flat)))
    return pa.table({**dict(zip(("doc_a", "doc_b", "overlap", "size_a", "size_b"), flat)), "jaccard": flat[2] / np.maximum(flat[3] + flat[4] - flat[2], 1)})


def _roots(seen: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of `seen` reaches by the pairs (a, b)."""
    i, j = np.searchsorted(seen, a), np.searchsorted(seen, b)
    low = np.arange(len(seen))
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return ids[seen][low]
        low = new


def _met(docs: DataFrame, n: int, threshold: float, most: int, share: int) -> tuple[DataFrame, DataFrame]:
    """(cells of documents to compare, (doc_id, set_id, size) of the documents that equal a smaller one)."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must lie in (0, 1] and n be positive")
    shared_checkpoints(docs.sparkSession)
    split, docs, parts = B.shares(docs, share), B.texts(docs), B.partitions(docs)
    each = B.cut(digests(docs, n))
    many = each.groupBy("d1", "d2").agg(F.min("doc_id").alias("set_id"), F.count("*").alias("c")).filter("c > 1")
    copies = each.join(many, ["d1", "d2"]).filter("doc_id > set_id").select("doc_id", "set_id", "size")
    copies = B.cut(copies)

    def feature(words: K.Words):
        h, row, _ = K.ngrams(words, n)
        return h, row

    kept = B.regroup(B.linked(docs, feature, split), _keep(threshold))
    kept = B.cut(kept.join(copies.select("doc_id"), "doc_id", "left_anti"))
    return B.gather(docs, B.exploded(kept), 4 * parts, most), copies


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, most: int = B.MOST, share: int = B.SHARE) -> DataFrame:
    """Pairs of documents whose word n-gram sets have Jaccard >= threshold (see the module's text)."""
    met, copies = _met(docs, n, threshold, most, share)
    found = met.groupBy(*B.CELL).applyInArrow(lambda t: compare(t, n, threshold, True), SCHEMA)
    size = F.col("size")
    return found.unionByName(copies.select(F.col("set_id").alias("doc_a"), F.col("doc_id").alias("doc_b"), size.alias("overlap"), size.alias("size_a"), size.alias("size_b"), F.lit(1.0).alias("jaccard")))


def similar_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, most: int = B.MOST, share: int = B.SHARE) -> DataFrame:
    """(doc_id, class_id, set_id, links) of each document with a partner (see the module's text)."""
    met, copies = _met(docs, n, threshold, most, share)
    found = met.groupBy(*B.CELL).applyInArrow(lambda t: compare(t, n, threshold, False), "doc_id long, other long, links long")
    found = B.cut(found)
    part = connected(found.filter("other <> doc_id").select(F.col("doc_id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy(F.col("doc_id").alias("set_id")).agg(F.sum("links").alias("links"))
    every = copies.select("doc_id", "set_id").unionByName(links.select("set_id").union(copies.select("set_id")).distinct().select(F.col("set_id").alias("doc_id"), "set_id"))
    out = every.join(links, "set_id", "left").join(part.select(F.col("id").alias("set_id"), "rep"), "set_id", "left")
    return out.select("doc_id", F.coalesce("rep", "set_id").alias("class_id"), "set_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def near_copies(pairs: DataFrame) -> DataFrame:
    """(gone_id): of the pairs (doc_a, doc_b), doc_a < doc_b, each document that has a pair with a smaller id that stays.

    A document is settled once all smaller ids of its pairs are, or one of them
    stays; so the rounds follow the longest chain of ascending ids.  Each round
    is checkpointed: lineage stays short and a lost executor costs one round.
    """
    edges = pairs.select("doc_a", "doc_b").checkpoint()
    gone = edges.select(F.col("doc_b").alias("gone_id")).limit(0)
    while True:
        low = edges.select("doc_a").distinct().join(edges.select(F.col("doc_b").alias("doc_a")), "doc_a", "left_anti")
        new = edges.join(low, "doc_a", "left_semi").select(F.col("doc_b").alias("gone_id")).distinct().checkpoint()
        if not new.limit(1).count():
            return gone
        gone = gone.unionByName(new)
        for end in ("doc_a", "doc_b"):
            edges = edges.join(new, edges[end] == new["gone_id"], "left_anti")
        edges = edges.checkpoint()


def keep_one(docs: DataFrame, n: int = N, threshold: float = NEAR_COPY) -> DataFrame:
    """docs without the documents of which a near copy with a smaller id stays; rows without id or text stay, and rows that share an id stay or go together, by the one that counts."""
    shared_checkpoints(docs.sparkSession)
    pairs = B.cut(jaccard_join(docs, n, threshold).select("doc_a", "doc_b", "jaccard"))
    # Equal sets: either their representative stays, or what stays for it is as near to them.
    equal = pairs.filter("jaccard = 1").select(F.col("doc_b").alias("gone_id"))
    gone = near_copies(pairs.filter("jaccard < 1")).unionByName(equal)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
