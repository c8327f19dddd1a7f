"""Finding documents that share hashed features, and bringing their texts together.

The three search operators that compare documents (n-gram Jaccard join,
substring chaining, suffix arrays) follow one plan:

1. ``postings``: each task hashes its texts into features and writes them as
   packed byte blocks, one per hash bucket and some million words.  A block
   costs the JVM one row, so no feature ever becomes a Spark row.
2. ``linked``: each bucket sorts its features; the documents of a feature are
   linked to the smallest of them, its anchor, and on demand to the one before
   them too.  This takes as many links as there are postings, or twice as many,
   never a square of a group's size.  Beyond SHARE documents a bucket is split
   into shares of the documents, so that a feature of them all fits a task.
3. ``regroup``: links are summed for each document; the caller's rule keeps
   the anchors that matter.  Whether its bounds lose a result is the caller's
   matter, and is stated there.
4. ``gather``: texts of documents that kept an anchor are joined back by id
   and grouped by anchor, so that each comparison sees whole texts.  An anchor
   of more than `most` features in all is split: into cells of one part of its
   members each, with the anchor in all of them (star), or into a cell for each
   two parts (pairs), so that no task holds an unbounded group.

Buckets follow spark.sql.shuffle.partitions, which is to be set in proportion
to the input, so that memory per task doesn't depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K

U64 = np.uint64
FLUSH = 2_000_000
Feature = Callable[[K.Words], tuple[np.ndarray, np.ndarray]]


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows that have both; other columns, clashing names included, are left."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")


#: Documents of a share.  A task sees the holders of a feature in one share, so a feature of all documents has so many postings there at most.
SHARE = 8_000_000


def shares(docs: DataFrame, per: int = SHARE) -> int:
    """Shares that the documents fall into by the hash of their id; only the column of ids is read."""
    return max(1, -(-docs.select("doc_id").count() // per))


def postings(docs: DataFrame, feature: Feature, buckets: int, split: int = 1, names: Callable[[K.Words], np.ndarray] | None = None) -> DataFrame:
    """Packed features of texts(docs): (bucket, data), bucket = hash bucket * split + share of the document.

    feature(words) gives (hashes, rows).  A block holds the ids and feature
    counts of its documents, and, sorted, 32 bits of hash with the document's
    number in the block.  Hash bits beyond those and the bucket are dropped:
    a collision adds a candidate and never loses one.  names(words) gives what
    stands for the documents instead of their ids.
    """

    def pack(ids: list, hashes: list, rows: list) -> Iterator[pa.RecordBatch]:
        doc = np.concatenate(ids)
        row = np.concatenate(rows).astype(U64)
        h = np.concatenate(hashes)
        bucket = (h >> U64(32)) % U64(buckets)
        if split > 1:
            bucket = bucket * U64(split) + (K.mix(doc.astype(U64) ^ U64(0x51A2E)) % U64(split))[row.astype(np.int64)]
        low = ((h & U64(0xFFFFFFFF)) << U64(16)) | row
        if buckets * split <= 0xFFFF:  # all in one word
            key = K.distinct(low | (bucket << U64(48)))
            bucket, low = (key >> U64(48)).astype(np.int64), key & U64(0xFFFFFFFFFFFF)
        else:
            order = np.lexsort((low, bucket))
            bucket, low = bucket[order].astype(np.int64), low[order]
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1])])
            bucket, low = bucket[new], low[new]
        size = np.bincount((low & U64(0xFFFF)).astype(np.int64), minlength=len(doc))
        out = []
        for s, e in zip(*_runs(bucket)):
            b, part = int(bucket[s]), low[s:e]
            if len(part):
                mine = (part & U64(0xFFFF)).astype(np.int64)
                used = np.flatnonzero(np.bincount(mine, minlength=len(doc)))
                place = np.zeros(len(doc), np.uint16)
                place[used] = np.arange(len(used))
                hash32 = (part >> U64(16)) & U64(0xFFFFFFFF)
                step = np.diff(hash32, prepend=U64(0)).astype(np.uint32)
                head = np.array([len(used), len(part)], dtype=np.uint32).tobytes()
                out.append((b, head + K.plane(doc[used]) + K.plane(size[used].astype(np.uint32)) + K.plane(step) + K.plane(place[mine])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, rows, held, ndocs = [], [], [], 0, 0
        for batch in batches:
            column, number = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            for at, piece in K.pieces(column):
                for sub in range(0, len(piece), 0x8000):
                    part = piece.slice(sub, 0x8000)
                    if ndocs + len(part) > 0xFFFF or held >= FLUSH:
                        if held:
                            yield from pack(ids, hashes, rows)
                        ids, hashes, rows, held, ndocs = [], [], [], 0, 0
                    h, row = feature(words := K.Words(part))
                    ids.append(names(words) if names else number[at + sub : at + sub + len(part)])
                    hashes.append(h)
                    rows.append(row + ndocs)
                    held += len(h)
                    ndocs += len(part)
        if held:
            yield from pack(ids, hashes, rows)

    return docs.mapInArrow(run, "bucket int, data binary")


def unpack(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document number) of every posting, and ids and sizes by number."""
    ids, sizes, hashes, where, base = [], [], [], [], 0
    for b in blocks:
        d, n = np.frombuffer(b, np.uint32, count=2)
        d, n, at = int(d), int(n), 8
        ids.append(K.unplane(b[at : at + 8 * d], d, np.int64))
        at += 8 * d
        sizes.append(K.unplane(b[at : at + 4 * d], d, np.uint32))
        at += 4 * d
        hashes.append(np.cumsum(K.unplane(b[at : at + 4 * n], n, np.uint32), dtype=U64))
        at += 4 * n
        where.append(K.unplane(b[at : at + 2 * n], n, np.uint16).astype(np.int64) + base)
        base += d
    return np.concatenate(hashes), np.concatenate(where), np.concatenate(ids), np.concatenate(sizes).astype(np.int64)


def linked(docs: DataFrame, feature: Feature, split: int, before: bool = False) -> DataFrame:
    """(target, data): packed (document, anchor, number of shared features, features of the document and of the anchor).

    The anchor is the smallest id among the documents of a feature, and is
    linked to itself.  Features of a single document make no link.  If `before`,
    each document is also linked to the next smaller id of the feature in its
    share, and no document to itself.

    With several shares the smallest holders of the shares are gathered first,
    one for each feature and share, and each share's links are made with the
    smallest of all; so no task sees more holders of a feature than a share has.
    """
    parts = partitions(docs)
    posted = postings(docs, feature, parts, split)
    if split == 1:
        return posted.groupBy("bucket").applyInArrow(lambda t: _links(t, None, parts, before), _LINKS)
    least = posted.groupBy("bucket").applyInArrow(lambda t: _least(t, split), "low int, data binary")
    known = least.groupBy("low").applyInArrow(_smallest, "low int, data binary")
    known = known.select(F.explode(F.sequence(F.col("low") * split, F.col("low") * split + (split - 1))).alias("bucket"), "data")
    return posted.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(lambda t, k: _links(t, k, parts, before), _LINKS)


_LINKS = "target int, data binary"


def _holders(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document's place in ids) sorted and distinct, ids ascending, and their sizes."""
    h, where, ids, sizes = unpack(table.column("data").to_pylist())
    known, number = np.unique(ids, return_inverse=True)
    size = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(size, number, sizes)
    key = K.distinct((h << U64(32)) | number[where].astype(U64))
    return key >> U64(32), (key & U64(0xFFFFFFFF)).astype(np.int64), known, size


def _firsts(top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a hash is met first, where each run begins)."""
    first = np.concatenate([[True], top[1:] != top[:-1]]) if len(top) else np.zeros(0, bool)
    return first, np.flatnonzero(first)


def _least(table: pa.Table, split: int) -> pa.Table:
    """The smallest holder of each feature in a share, its size, and whether there are more."""
    if not table.num_rows:
        return pa.table({"low": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
    top, doc, ids, size = _holders(table)
    _, start = _firsts(top)
    more = np.diff(np.concatenate([start, [len(top)]])) > 1
    return _known(int(table.column("bucket")[0].as_py()) // split, top[start], ids[doc[start]], size[doc[start]], more)


def _known(low: int, top: np.ndarray, ids: np.ndarray, size: np.ndarray, more: np.ndarray) -> pa.Table:
    body = np.uint32(len(top)).tobytes() + K.plane(top.astype(np.uint32)) + K.plane(ids) + K.plane(size.astype(np.uint32)) + more.astype(np.uint8).tobytes()
    return pa.table({"low": pa.array([low], pa.int32()), "data": pa.array([body], pa.binary())})


def _read_known(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cols: list[list] = [[], [], [], []]
    for b in blocks:
        m, at = int(np.frombuffer(b, np.uint32, count=1)[0]), 4
        for c, kind in zip(cols, (np.uint32, np.int64, np.uint32, np.uint8)):
            n = m * np.dtype(kind).itemsize
            c.append(K.unplane(b[at : at + n], m, kind))
            at += n
    top, ids, size, more = (np.concatenate(c) for c in cols)
    return top.astype(U64), ids, size.astype(np.int64), more > 0


def _smallest(table: pa.Table) -> pa.Table:
    """Of a bucket's features that more than one document holds, the smallest holder over all shares."""
    top, ids, size, more = _read_known(table.column("data").to_pylist())
    order = np.lexsort((ids, top))
    top, ids, size, more = top[order], ids[order], size[order], more[order]
    _, start = _firsts(top)
    shared = (np.diff(np.concatenate([start, [len(top)]])) > 1) | np.maximum.reduceat(more, start)
    start = start[shared]
    return _known(int(table.column("low")[0].as_py()), top[start], ids[start], size[start], more[start])


def _links(table: pa.Table, least: pa.Table | None, targets: int, before: bool) -> pa.Table:
    if not table.num_rows:
        return pa.table({"target": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
    top, doc, known, size = _holders(table)
    first, start = _firsts(top)
    length = np.diff(np.concatenate([start, [len(top)]]))
    if least is None:  # all holders are here: anchors are places in ids too
        names, far = known, size
        anchor = np.repeat(doc[start], length) if len(start) else doc
        shared = ~first if before else np.repeat(length > 1, length)
        pair = (doc[shared].astype(U64) << U64(32)) | anchor[shared].astype(U64)
        if before:
            near = np.flatnonzero(~first)
            near = near[doc[near - 1] != anchor[near]]
            pair = np.concatenate([pair, (doc[near].astype(U64) << U64(32)) | doc[near - 1].astype(U64)])
    else:
        keys, ids, sizes, _ = _read_known(least.column("data").to_pylist()) if least.num_rows else (top[:0], known[:0], size[:0], None)
        place = np.minimum(np.searchsorted(keys, top), max(len(keys) - 1, 0))
        shared = keys[place] == top if len(keys) else np.zeros(len(top), bool)
        anchor, of = (ids[place], sizes[place]) if len(keys) else (top.astype(np.int64), top.astype(np.int64))
        if before:
            later = np.flatnonzero(shared & (known[doc] != anchor))
            near = np.flatnonzero(~first)
            near = near[known[doc[near - 1]] != anchor[near]]
            d = np.concatenate([doc[later], doc[near]])
            a, of = np.concatenate([anchor[later], known[doc[near - 1]]]), np.concatenate([of[later], size[doc[near - 1]]])
        else:
            d, a, of = doc[shared], anchor[shared], of[shared]
        names, number = np.unique(a, return_inverse=True)
        far = np.zeros(len(names), np.int64)
        far[number] = of
        pair = (d.astype(U64) << U64(32)) | number.astype(U64)
    pair, n = np.unique(pair, return_counts=True)
    d, a = (pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(np.int64)
    target = (K.mix(known.astype(U64)) % U64(targets)).astype(np.int64)[d] if len(d) else d
    order = np.argsort(target, kind="stable")
    d, a, n, target = d[order], a[order], n[order], target[order]
    out_t, out_b = [], []
    for s, e in zip(*_runs(target)):
        m = e - s
        out_t.append(int(target[s]))
        out_b.append(np.uint32(m).tobytes() + K.plane(known[d[s:e]]) + K.plane(names[a[s:e]]) + K.plane(n[s:e].astype(np.uint32)) + K.plane(size[d[s:e]].astype(np.uint32)) + K.plane(far[a[s:e]].astype(np.uint32)))
    return pa.table({"target": pa.array(out_t, pa.int32()), "data": pa.array(out_b, pa.binary())})


def _runs(a: np.ndarray) -> tuple[list, list]:
    if not len(a):
        return [], []
    s = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return s.tolist(), np.concatenate([s[1:], [len(a)]]).tolist()


Keep = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def regroup(linked: DataFrame, keep: Keep) -> DataFrame:
    """(doc_id, size, anchors, sizes): the links that keep(document, anchor, n, size) chooses, with the anchors' sizes; rows come sorted by document, then n from the largest."""

    def run(table: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], [], []]
        for b in table.column("data").to_pylist():
            m, at = int(np.frombuffer(b, np.uint32, count=1)[0]), 4
            for c, kind in zip(cols, (np.int64, np.int64, np.uint32, np.uint32, np.uint32)):
                size = m * np.dtype(kind).itemsize
                c.append(K.unplane(b[at : at + size], m, kind))
                at += size
        doc, anchor, n, size, theirs = (np.concatenate(c).astype(np.int64) for c in cols)
        order = np.lexsort((anchor, doc))
        doc, anchor, n, size, theirs = (x[order] for x in (doc, anchor, n, size, theirs))
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])]))
        n, size, theirs = np.add.reduceat(n, new), np.minimum.reduceat(size, new), np.minimum.reduceat(theirs, new)
        doc, anchor = doc[new], anchor[new]
        order = np.lexsort((anchor, -n, doc))
        doc, anchor, n, size, theirs = (x[order] for x in (doc, anchor, n, size, theirs))
        kept = keep(doc, anchor, n, size)
        doc, anchor, size, theirs = doc[kept], anchor[kept], size[kept], theirs[kept]
        s, e = _runs(doc)
        at = pa.array([*s, len(doc)] if s else [0], pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int64())) for x in (anchor, theirs)]
        return pa.table({"doc_id": pa.array(doc[s] if s else [], pa.int64()), "size": pa.array(size[s] if s else [], pa.int64()), "anchors": lists[0], "sizes": lists[1]})

    return linked.groupBy("target").applyInArrow(run, "doc_id long, size long, anchors array<long>, sizes array<long>")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """checkpoint(), after which the shuffle files that led there are removed: nothing needs them any more."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        conf.set(_CLEAN, before)


#: Columns that name a cell: documents are compared with those of the same cell.
CELL = ["block", "hot", "lo", "hi"]
MOST = 8_000_000


def exploded(kept: DataFrame) -> DataFrame:
    """(doc_id, size, anchor, partner): a row for each anchor of each document, to meet the anchor there."""
    return kept.select("doc_id", "size", F.explode("anchors").alias("anchor")).withColumn("partner", F.col("anchor"))


def gather(docs: DataFrame, link: DataFrame, blocks: int, most: int = MOST, star: bool = False) -> DataFrame:
    """(block, hot, lo, hi, part, doc_id, text, anchors, mine): each document's text once for each cell that its anchors fall into.

    anchors are all of the document's, mine the partners that it has to meet in
    this cell.  Anchors share a block by hash (hot 0, lo and hi -1); one whose
    documents have over `most` features has cells of its own (hot is its id):
    documents get a part by hash, and cell (lo, hi) holds parts lo and hi; in a
    star lo = hi, and the anchor is in all cells.  link is read twice: pass what
    is checkpointed.
    """
    if star:
        link = link.unionByName(link.select(F.col("anchor").alias("doc_id"), F.lit(0).cast("long").alias("size"), "anchor", F.col("anchor").alias("partner")).distinct())
    hot = link.groupBy("anchor").agg(F.sum("size").alias("w")).filter(F.col("w") > most).select(F.col("anchor").alias("popular"), F.ceil(F.col("w") / most).cast("int").alias("cells"))
    link = link.join(hot, F.col("anchor") == F.col("popular"), "left")
    slot, part, every = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("cells")).cast("int"), F.sequence(F.lit(0), F.col("cells") - 1)
    none = F.lit(-1)

    def cell(lo, hi, mine):
        return F.struct(slot.alias("block"), F.when(F.col("cells").isNull(), F.lit(0).cast("long")).otherwise(F.col("anchor")).alias("hot"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), mine.cast("int").alias("part"))

    if star:
        popular = F.when(F.col("doc_id") == F.col("anchor"), F.transform(every, lambda j: cell(j, j, j))).otherwise(F.array(cell(part, part, part)))
    else:
        popular = F.transform(every, lambda j: cell(F.least(part, j), F.greatest(part, j), part))
    link = link.select("doc_id", "anchor", "partner", F.explode(F.when(F.col("cells").isNull(), F.array(cell(none, none, none))).otherwise(popular)).alias("cell"))
    met = link.groupBy(F.col("doc_id").alias("kept_id")).agg(F.collect_list(F.struct("cell", "anchor", "partner")).alias("met"))
    met = docs.join(met, F.col("doc_id") == F.col("kept_id"))
    anchors = F.array_sort(F.array_distinct(F.transform("met", lambda m: m["anchor"])))
    spread = met.select("doc_id", "text", "met", anchors.alias("anchors"), F.explode(F.array_distinct(F.transform("met", lambda m: m["cell"]))).alias("cell"))
    mine = F.transform(F.filter("met", lambda m: m["cell"] == F.col("cell")), lambda m: m["partner"])
    return spread.select("cell.*", "doc_id", "text", "anchors", mine.alias("mine"))


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    off = a.offsets.to_numpy().astype(np.int64)
    return a.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]] if len(off) else np.zeros(0, np.int64), off - off[0]


def by_id(table: pa.Table) -> pa.Table:
    """One row for each doc_id, in its order: of repeated ids the smallest text counts."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    d = table.column("doc_id").to_numpy()
    return table.take(np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))) if len(d) else table


def one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
