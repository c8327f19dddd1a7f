"""Operator 2: approximate nearest neighbours by a permutation index.

Each vector is represented by the ordered list of its LIST nearest pivots and
posted in the inverted files of the POST nearest ones, the same number at every
size of the table.  Queries are the vectors whose id is divisible by `every`;
each probes the files of its nearest PROBE of all pivots, so the share of the
table that a query meets doesn't change with the number of pivots either.

In a file the vectors are ranked by the footrule distance between their list
and the query's (a missing pivot counts as rank LIST).  With weights LIST - rank
the footrule is a constant minus twice the sum of the smaller weights; weights
are coded in LEVELS steps of one byte, and the sum runs over one byte column a
pivot of the query.  No cosine is computed before: only the best RERANK of a
file, LEAST at least, are reranked by exact cosine; the best of all files stay.

A file of over TARGET postings is cut into parts, and its queries into chunks of
as many; each part meets each chunk in a task of its own, so tasks stay bounded
and no pair is lost, even if one file holds a third of the table.

Pivots are a sample of the vectors by the hash of their id; their number grows
with the square root of the table up to MAX_PIVOTS, so what is sent to each task
is bounded.  Every vector is indexed.  A query's work grows with the table, as a
fixed share of it is ranked by bytes; the README has measured recall and work.

Result: (vec_id, neighbor_id, similarity, rank), K rows for each query that
meets so many vectors; ties go to the smaller id.

Defined cases: null ids or vectors, empty vectors, and vectors with a null or
non-finite entry, of another length than most, or of length zero are left out;
of rows that repeat an id the first in the order of values counts; equal vectors
are neighbours at 1.0; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import blocks as B
from weftgraph.llm import kernels as K

NEIGHBOURS, LIST, LEVELS, POST, PROBE, RERANK, LEAST = 10, 64, 3, 8, 1 / 8, 0.08, 64
EVERY = 20
TARGET, PER_PIVOT, PIVOTS, MAX_PIVOTS = 20_000, 16, 256, 4096
QUERIES = 64


def pivots_for(n: int) -> int:
    """16 vectors a pivot up to PIVOTS, then growing with the square root of the table."""
    most = max(PIVOTS, round(PIVOTS * (n / 65536) ** 0.5))
    return max(1, min(n, MAX_PIVOTS, most, max(8, n // PER_PIVOT)))


def _matrix(column: pa.Array) -> np.ndarray:
    values, _ = B.lists(column)
    return values.reshape(len(column), -1).astype(np.float32) if len(column) else np.zeros((0, 1), np.float32)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the usable vectors, one for each id."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    good = v.filter("vec_id is not null and embedding is not null and size(embedding) > 0").filter(F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < 1e18) and exists(embedding, x -> abs(x) > 1e-18)"))
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    good = good.join(F.broadcast(sizes), F.size("embedding") == F.col("d")).select("vec_id", "embedding")
    return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def codes(perm: np.ndarray, pivots: int) -> np.ndarray:
    """(pivot, vector) byte codes of lists of pivots: LEVELS for the first ranks, down to 1, and 0 for a missing pivot."""
    size, listed = perm.shape
    out = np.zeros((pivots, size), np.uint8)
    weight = (LEVELS - np.arange(listed) * LEVELS // listed).astype(np.uint8)
    out[perm.T.ravel(), np.tile(np.arange(size), listed)] = np.repeat(weight, size)
    return out


def nearness(table: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(query, vector) sum of the smaller weights: LIST * LEVELS fits a byte."""
    acc = np.zeros((len(queries), table.shape[1]), np.uint8)
    held = np.empty_like(acc)
    listed = queries.shape[1]
    for rank in range(listed):
        np.take(table, queries[:, rank], axis=0, out=held)
        np.minimum(held, np.uint8(LEVELS - rank * LEVELS // listed), out=held)
        acc += held
    return acc


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, target: int = TARGET) -> DataFrame:
    """The k nearest vectors by cosine, approximately, of each vector whose id is divisible by `every` (see the module's text)."""
    good = clean(vectors)
    n = good.count()
    m = pivots_for(n)
    chosen = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(m).collect()
    pivots = _unit(np.array([r["embedding"] for r in chosen], np.float32)) if chosen else np.zeros((0, 1), np.float32)
    listed, posts, probes = min(LIST, m), min(POST, m), max(min(POST, m), math.ceil(PROBE * m))

    def lists_of(unit: np.ndarray, most: int) -> np.ndarray:
        near = -(unit @ pivots.T)
        top = np.argpartition(near, most - 1, axis=1)[:, :most] if most < m else np.tile(np.arange(m), (len(unit), 1))
        return np.take_along_axis(top, np.lexsort((top, np.take_along_axis(near, top, 1)), axis=1), 1)

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids, unit = part.column(0).to_numpy(zero_copy_only=False), _unit(_matrix(part.column(1)))
                asks = np.flatnonzero(ids % every == 0)
                yield ids, unit, lists_of(unit, listed), asks, lists_of(unit[asks], max(listed, probes)) if len(asks) else np.zeros((0, max(listed, probes)), np.int64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, m), np.int64)
        for _, _, order, _, wide in read(batches):
            total[0] += np.bincount(order[:, :posts].ravel(), minlength=m)
            total[1] += np.bincount(wide[:, :probes].ravel(), minlength=m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array(total[0]), pa.array(total[1])], ["file", "n", "asked"])

    parts, chunks = np.ones(m, np.int64), np.ones(m, np.int64)
    if n > target:  # else no file can be that large
        for r in good.mapInArrow(tally, "file long, n long, asked long").groupBy("file").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked")).collect():
            parts[r["file"]], chunks[r["file"]] = max(1, -(-r["n"] // target)), max(1, -(-r["asked"] // target))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(file, part, chunk, who, rank, perm, unit, ids):
            key = ((file << 20) | part) << 20 | chunk
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[who]), pa.array(np.full(len(who), rank, np.int32)), pa.array([perm[r] for r in who], pa.binary()), pa.array([unit[r] for r in who], pa.binary())], ["file", "vec_id", "probe", "perm", "unit"])

        for ids, units, order, asks, wide in read(batches):
            perm, unit = [p.tobytes() for p in order.astype(np.uint16)], [u.tobytes() for u in units]
            mixed = (K.mix(ids.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
            for j in range(posts):
                file = order[:, j]
                for chunk in range(int(chunks[file].max(initial=1))):
                    who = np.flatnonzero(chunks[file] > chunk)
                    yield rows(file[who], (mixed % parts[file])[who], chunk, who, -1, perm, unit, ids)
            asked = dict(zip(asks.tolist(), (p.tobytes() for p in wide.astype(np.uint16))))
            for j in range(probes if len(asks) else 0):
                file = wide[:, j]
                for part in range(int(parts[file].max(initial=1))):
                    some = np.flatnonzero(parts[file] > part)
                    who = asks[some]
                    yield rows(file[some], part, mixed[who] % chunks[file[some]], who, j, asked, unit, ids)

    def rank(table: pa.Table) -> pa.Table:
        probe = table.column("probe").to_numpy()
        ids = table.column("vec_id").to_numpy()
        dim = len(table.column("unit")[0].as_py()) // 4

        def side(rows: np.ndarray, width: int):
            rows = rows[np.lexsort((probe[rows], ids[rows]))]
            part = table.take(pa.array(rows))
            perm = np.frombuffer(b"".join(part.column("perm").to_pylist()), np.uint16).reshape(len(rows), width).astype(np.int64)
            return ids[rows], perm, np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float32).reshape(len(rows), dim)

        held, asked = np.flatnonzero(probe < 0), np.flatnonzero(probe >= 0)
        out: list[tuple] = []
        if len(held) and len(asked):
            mine, perm, unit = side(held, listed)
            who, wide, query = side(asked, max(listed, probes))
            coded = codes(perm, m)
            take = min(len(mine), max(LEAST, math.ceil(RERANK * len(mine))))
            for s in range(0, len(who), QUERIES):
                near = nearness(coded, wide[s : s + QUERIES, :listed])
                best = np.argpartition(near, len(mine) - take, axis=1)[:, len(mine) - take :] if take < len(mine) else np.tile(np.arange(len(mine)), (len(near), 1))
                for i in range(len(near)):
                    q, c = s + i, np.sort(best[i])
                    c = c[mine[c] != who[q]]
                    if not len(c):
                        continue
                    sim = unit[c].astype(np.float64) @ query[q].astype(np.float64)
                    top = np.lexsort((mine[c], -sim))[:k]
                    out.append((np.full(len(top), who[q]), mine[c[top]], sim[top]))
        a, b, sim = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"vec_id": a, "neighbor_id": b, "similarity": sim})

    posted = good.mapInArrow(post, "file long, vec_id long, probe int, perm binary, unit binary")
    found = posted.groupBy("file").applyInArrow(rank, "vec_id long, neighbor_id long, similarity double")
    w = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbor_id")
    found = found.groupBy("vec_id", "neighbor_id").agg(F.max("similarity").alias("similarity"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
