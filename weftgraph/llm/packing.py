"""Operators 8 and 10: token matrices by best-fit decreasing, and packing with certified bounds.

Both cut documents longer than `length` tokens into chunks of `length` and a
rest, without loss, and place chunks by best-fit decreasing: the longest first,
each into the fullest row that still holds it.  That row is found by a descent
in a segment tree over free capacities 1 .. length, whose nodes tell whether a
row with such a capacity is open.

token_matrices (8) packs each task's documents, at most `group` tokens at a
time, and makes rows of ids with cumulative segment lengths and position resets;
write_matrices puts them into raw files.

certified_packing (10) packs lengths only.  Documents fall by the hash of their
id into groups of about `per` tokens, whatever the session's settings.  For each
group dual feasible functions give a lower bound on its rows; a group that
reaches it is certified and done.  In each round the groups with a gap meet in
new tasks, about two by two and by a hash that differs from round to round, so
any two may meet; rows that aren't full exchange their documents, best-fit
decreasing is run again over these, and the new rows stay if they are fewer.

Defined cases: null ids or texts give nothing, and a text without tokens takes
no place; texts of any length are cut and packed whole; rows that repeat an id
are packed each; equal sizes go by id, then place in the text; other columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import blocks as B
from weftgraph.llm import kernels as K
from weftgraph.llm import tokens
from weftgraph.session import shared_checkpoints

LENGTH = 2048
GROUP = 16_000_000
PER = 4_000_000
MATRIX = "row long, ids binary, used int, cu_seqlens array<int>, position_resets array<int>, first_positions array<int>, doc_ids array<long>"
PACKED = "group int, bin int, used int, n int, doc_ids array<long>, starts array<long>, lengths array<int>, group_bins int, lower_bound int, certified boolean"


class Capacities:
    """A segment tree over capacities 0 .. top: the smallest open one that is at least x, in logarithmic steps."""

    def __init__(self, top: int):
        self.size = 1 << max(1, (top + 1).bit_length())
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(top + 1)]

    def push(self, capacity: int, b: int) -> None:
        self.bins[capacity].append(b)
        if len(self.bins[capacity]) == 1:
            self._set(capacity, 1)

    def pop(self, capacity: int) -> int:
        b = self.bins[capacity].pop()
        if not self.bins[capacity]:
            self._set(capacity, 0)
        return b

    def _set(self, i: int, value: int) -> None:
        i += self.size
        tree = self.tree
        tree[i] = value
        i >>= 1
        while i:
            new = tree[2 * i] | tree[2 * i + 1]
            if tree[i] == new:
                break
            tree[i] = new
            i >>= 1

    def ceiling(self, x: int) -> int:
        """The smallest open capacity >= x, or -1."""
        i, tree = x + self.size, self.tree
        if tree[i]:
            return x
        while i > 1:
            if not i & 1 and tree[i + 1]:  # a right sibling holds one
                i += 1
                while i < self.size:
                    i = 2 * i + (not tree[2 * i])
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(sizes: np.ndarray, length: int) -> np.ndarray:
    """The bin of each item of size 1 .. length; equal sizes go in the order given."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    full = int(np.searchsorted(-sizes[order], -length, "right"))
    out[order[:full]] = np.arange(full)  # items that fill a bin
    tree, used = Capacities(length), full
    for k, x in zip(order[full:].tolist(), sizes[order[full:]].tolist()):
        c = tree.ceiling(x)
        if c < 0:
            b, c = used, length
            used += 1
        else:
            b = tree.pop(c)
        out[k] = b
        if c > x:
            tree.push(c - x, b)
    return out


def lower_bound(sizes: np.ndarray, length: int) -> int:
    """Bins that any packing needs, by two families of dual feasible functions.

    For a threshold e up to half the length: sizes over length - e count as
    whole bins, sizes under e as nothing, others as their share; and for k up
    to 20, x counts as floor((k + 1) x / length) / k unless (k + 1) x / length
    is whole, when it keeps its share.
    """
    if not len(sizes):
        return 0
    best = -(-int(sizes.sum()) // length)
    s = np.sort(sizes).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(s)])
    for e in np.unique(s[s * 2 <= length]).tolist():
        low, high = int(np.searchsorted(s, e)), int(np.searchsorted(s, length - e, "right"))
        best = max(best, len(s) - high + -(-int(total[high] - total[low]) // length))
    for k in range(1, 21):
        scaled = (k + 1) * s
        exact = scaled % length == 0
        # in units of 1 / (k * length), so that sums stay whole
        units = int(np.where(exact, s * k, (scaled // length) * length).sum())
        best = max(best, -(-units // (k * length)))
    return best


def chunks(ids: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, start, size) of the lossless cut of documents into at most `length` tokens."""
    n = -(-sizes // length)
    doc = np.repeat(np.arange(len(ids)), n)
    start = K.expand(n) * length
    return doc, start, np.minimum(length, sizes[doc] - start)


def _open(docs: DataFrame) -> DataFrame:
    return B.texts(docs)


def token_matrices(docs: DataFrame, ranks: str = tokens.DEFAULT_RANKS, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Rows of `length` ids, little endian, 16 bits each if the vocabulary (with one id for padding) fits, else 32.

    Segment i of a row lies at cu_seqlens[i] .. cu_seqlens[i + 1]; positions
    start anew at position_resets, from first_positions (a later chunk of a
    document goes on where the last one ended).  Padding is the id one past
    the vocabulary.  doc_ids name the segments' documents.
    """

    def pack(ids: np.ndarray, flat: np.ndarray, offsets: np.ndarray, base: int) -> pa.RecordBatch:
        encoder = tokens.get(ranks)
        kind = np.uint16 if encoder.vocabulary < 1 << 16 else np.uint32
        doc, start, size = chunks(ids, np.diff(offsets), length)
        bins = best_fit_decreasing(size, length)
        order = np.argsort(bins, kind="stable")
        doc, start, size, bins = doc[order], start[order], size[order], bins[order]
        rows = int(bins[-1]) + 1
        cut = np.searchsorted(bins, np.arange(rows + 1))
        before = np.cumsum(size) - size
        place = before - before[cut[:-1]][bins]
        matrix = np.full((rows, length), encoder.vocabulary, kind)
        inner = K.expand(size)
        matrix.reshape(-1)[np.repeat(bins * length + place, size) + inner] = flat[np.repeat(offsets[:-1][doc] + start, size) + inner]
        used = np.add.reduceat(size, cut[:-1])
        cu = np.insert(place + size, cut[:-1], 0)
        lists = lambda v, o, t: pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, t))
        body = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.arange(rows + 1) * length * kind().itemsize).astype(np.int32)), pa.py_buffer(matrix)])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(rows) + base), body, pa.array(used, pa.int32()), lists(cu, cut + np.arange(rows + 1), pa.int32()), lists(place, cut, pa.int32()), lists(start, cut, pa.int32()), lists(ids[doc], cut, pa.int64())],
            [x.split()[0] for x in MATRIX.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = tokens.get(ranks), []
        base = TaskContext.get().partitionId() << 32  # row numbers are unique over tasks

        def flush():
            nonlocal held, base
            ids = np.concatenate([x[0] for x in held])
            flat = np.concatenate([x[1] for x in held])
            sizes = np.concatenate([np.diff(x[2]) for x in held])
            held = []
            if len(flat):
                out = pack(ids, flat, np.concatenate([[0], np.cumsum(sizes)]), base)
                base += out.num_rows
                for at in range(0, out.num_rows, 2048):
                    yield out.slice(at, 2048)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, piece in K.pieces(batch.column(1)):
                flat, offsets = encoder.encode(piece)
                held.append((ids[at : at + len(piece)], flat.astype(np.uint16) if encoder.vocabulary < 1 << 16 else flat, offsets))
                if sum(len(x[1]) for x in held[-1:]) and sum(len(x[1]) for x in held) >= group:
                    yield from flush()
        if held:
            yield from flush()

    return _open(docs).mapInArrow(run, MATRIX)


def lengths(docs: DataFrame, ranks: str = tokens.DEFAULT_RANKS) -> DataFrame:
    """(doc_id, tokens) of each row with an id and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.get(ranks)
        for batch in batches:
            n = [encoder.lengths(piece) for _, piece in K.pieces(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else [], pa.int64())], ["doc_id", "tokens"])

    return _open(docs).mapInArrow(run, "doc_id long, tokens long")


class Group:
    """Chunks of one group and their bins."""

    def __init__(self, doc: np.ndarray, start: np.ndarray, size: np.ndarray, bins: np.ndarray, bound: int):
        self.doc, self.start, self.size, self.bins, self.bound = doc, start, size, bins, bound
        self.count = int(bins.max()) + 1 if len(bins) else 0

    @classmethod
    def of(cls, doc: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> "Group":
        order = np.lexsort((start, doc, -size))
        doc, start, size = doc[order], start[order], size[order]
        return cls(doc, start, size, best_fit_decreasing(size, length), lower_bound(size, length))

    def meet(self, other: "Group", length: int) -> "Group":
        """Both groups as one; if one has a gap, the rows that aren't full exchange documents."""
        doc, start, size = (np.concatenate([getattr(self, x), getattr(other, x)]) for x in ("doc", "start", "size"))
        bins = np.concatenate([self.bins, other.bins + self.count])
        total = self.count + other.count
        if self.count > self.bound or other.count > other.bound:
            used = np.bincount(bins, weights=size, minlength=total)
            loose = used[bins] < length
            order = np.flatnonzero(loose)[np.lexsort((start[loose], doc[loose], -size[loose]))]
            new = best_fit_decreasing(size[order], length)
            closed, kept = np.unique(bins[~loose], return_inverse=True)
            if len(order) and len(closed) + int(new.max()) + 1 < total:
                bins = np.empty_like(bins)
                bins[~loose] = kept
                bins[order] = new + len(closed)
        return Group(doc, start, size, bins, max(lower_bound(size, length), 0))


def certified_packing(docs: DataFrame, ranks: str = tokens.DEFAULT_RANKS, length: int = LENGTH, per: int = PER, rounds: int = 3) -> DataFrame:
    """One row for each bin, with its documents' chunks and its group's bin count, lower bound and certificate."""
    shared_checkpoints(docs.sparkSession)
    sized = B.cut(lengths(docs, ranks).filter("tokens > 0"))
    groups = max(1, -(-(sized.agg(F.sum("tokens")).head()[0] or 0) // per))

    def pack(table: pa.Table) -> pa.Table:
        doc, start, size = chunks(*(table.column(c).to_numpy() for c in ("doc_id", "tokens")), length)
        return _rows(Group.of(table.column("doc_id").to_numpy()[doc], start, size, length), int(table.column("part")[0].as_py()))

    def meet(table: pa.Table) -> pa.Table:
        met = None
        owner = table.column("group").to_numpy()
        for g in np.unique(owner):
            mine = _group(table.filter(pa.array(owner == g)))
            met = mine if met is None else met.meet(mine, length)
        return _rows(met, int(owner.min()))

    state = B.cut(sized.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")).groupBy("part").applyInArrow(pack, PACKED))
    done = state.filter("certified")
    for k in range(rounds):
        gaps = state.filter("not certified")
        n = gaps.select("group").distinct().count()
        if n < 2:
            break
        pair = F.pmod(F.xxhash64("group", F.lit(k)), F.lit(-(-n // 2))).cast("int")
        state = B.cut(gaps.withColumn("pair", pair).groupBy("pair").applyInArrow(meet, PACKED))
        done = done.unionByName(state.filter("certified"))
    return done.unionByName(state.filter("not certified"))


def _group(rows: pa.Table) -> Group:
    """The group of which these are the bins."""
    size, at = B.lists(rows.column("lengths"))
    bins = np.repeat(np.arange(len(rows)), np.diff(at))
    return Group(B.lists(rows.column("doc_ids"))[0], B.lists(rows.column("starts"))[0], size.astype(np.int64), bins, int(rows.column("lower_bound")[0].as_py()))


def _rows(g: Group, name: int) -> pa.Table:
    order = np.lexsort((g.start, g.doc, -g.size, g.bins))
    doc, start, size, bins = g.doc[order], g.start[order], g.size[order], g.bins[order]
    cut = np.searchsorted(bins, np.arange(g.count + 1))
    lists = lambda v, t: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, t))
    same = lambda v, t: pa.array(np.full(g.count, v), t)
    return pa.table({"group": same(name, pa.int32()), "bin": pa.array(np.arange(g.count), pa.int32()), "used": pa.array(np.add.reduceat(size, cut[:-1]), pa.int32()), "n": pa.array(np.diff(cut), pa.int32()), "doc_ids": lists(doc, pa.int64()), "starts": lists(start, pa.int64()), "lengths": lists(size, pa.int32()), "group_bins": same(g.count, pa.int32()), "lower_bound": same(g.bound, pa.int32()), "certified": same(g.count == g.bound, pa.bool_())})


def write_matrices(matrices: DataFrame, folder: str) -> DataFrame:
    """Raw files of token_matrices in a folder that all executors share: (file, rows, bytes) of each task that has rows.

    part-N.bin has the ids row after row; part-N.npz has row, used, doc_ids,
    first_positions and cu_seqlens (flat, with offsets), the position resets
    being cu_seqlens without each row's last.  A task writes under another name
    and renames at the end, so a retried one replaces what it left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, own = f"part-{task.partitionId():05d}", f".{task.taskAttemptId()}"
        os.makedirs(folder, exist_ok=True)
        rows, held, size = 0, [], 0
        with open(f"{folder}/{name}{own}", "wb") as f:
            for batch in batches:
                for x in batch.column(batch.schema.get_field_index("ids")).to_pylist():
                    size += f.write(x)
                rows += batch.num_rows
                held.append(batch.drop_columns(["ids"]))
        if not rows:
            os.remove(f"{folder}/{name}{own}")
            return
        t = pa.Table.from_batches(held)
        arrays = {c: t.column(c).to_numpy() for c in ("row", "used")}
        for c in ("doc_ids", "first_positions", "cu_seqlens"):
            arrays[c], arrays[f"{c}_offsets"] = B.lists(t.column(c))
        with open(f"{folder}/{name}.npz{own}", "wb") as f:
            np.savez(f, **arrays)
        for end in (".bin", ".npz"):
            os.replace(f"{folder}/{name}{own}" if end == ".bin" else f"{folder}/{name}.npz{own}", f"{folder}/{name}{end}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.bin"]), pa.array([rows], pa.int64()), pa.array([size], pa.int64())], ["file", "rows", "bytes"])

    return matrices.mapInArrow(run, "file string, rows long, bytes long")
