"""Operator 9: a logarithmic family of suffix arrays for long exact repeats.

Documents that share a winnowed SEED_K-mer are brought together under its first
document (blocks.py); any MIN_WORDS equal words share one, so all documents
that hold a given window of MIN_WORDS words meet.  In each block documents
arrive in batches by id.  A batch gets a suffix array over its words, is
merge-scanned against every level of the family, and becomes a level; levels of
the same size class merge, so n words lie in at most log n levels and each word
is merged a logarithmic number of times.  Only batches are sorted: a batch's
suffixes find their places in a level by binary search, which gives both the
matches and, when the two merge, the new order.

An array orders the suffixes that have MIN_WORDS words before their document
ends, one for each distinct window of so many words, by 16 bits of each of those words and last by a 64-bit hash of all of
them.  It is cut at that depth: whether more words match is read off the
neighbouring suffixes, as matches are windows that overlap.

An anchor whose documents have over `most` seeds is not compared in one task:
its documents are posted once more by whole windows of MIN_WORDS words.  The
first document of a window holds that very window, so meeting this one is
enough, and its documents are split over as many tasks as they need.

Result: (doc_id, start, end, length, match_doc): the maximal unions of those
windows of MIN_WORDS words of a document that an earlier document (smaller id)
holds too, in word positions, and the smallest such document.  The result
doesn't depend on blocks or batches.

Defined cases: null ids or texts and texts under MIN_WORDS words give nothing;
repeats inside one document don't count; of rows that repeat an id the smallest
text counts; of equal matches the smallest document is named; other columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import blocks as B
from weftgraph.llm import kernels as K
from weftgraph.llm.collinear import seeds
from weftgraph.session import shared_checkpoints

SEED_K, WINDOW, MIN_WORDS = 16, 16, 50
BATCH_WORDS = 1 << 16
MOST = 500_000  # seeds, one for about eight words


class Level:
    """The distinct windows of `depth` words of some documents, in the order of their suffixes.

    at, doc and window lie in that order: a place in the text, the smallest
    document that holds the window, and the hash of its words.
    """

    FIELDS = ("at", "doc", "window")

    def __init__(self, depth: int, code: np.ndarray, at: np.ndarray, doc: np.ndarray, window: np.ndarray):
        self.depth, self.code, self.at, self.doc, self.window = depth, code, at, doc, window
        self.first = self.key(0, at)

    def __len__(self) -> int:
        return len(self.at)

    @property
    def rounds(self) -> int:
        return -(-self.depth // 4)

    def key(self, j: int, at: np.ndarray) -> np.ndarray:
        """16 bits each of words 4j .. 4j + 3 of the suffixes at `at`, none beyond the depth."""
        over = 4 * (j + 1) - self.depth
        k = self.code[at + 4 * j]
        return k >> K.U64(16 * over) if over > 0 else k

    @classmethod
    def of(cls, ids: list[int], words: list[np.ndarray], depth: int) -> tuple["Level", np.ndarray, np.ndarray, np.ndarray]:
        """The suffix array of a batch, by keys of four words, among ties only after the first; and its suffixes as (document, position, place in the level)."""
        size = np.array([len(w) for w in words], np.int64)
        text = np.concatenate(words) if words else np.zeros(0, K.U64)
        begin = np.cumsum(size) - size
        per = np.maximum(size - depth + 1, 0)
        pos = K.expand(per)
        at = np.repeat(begin, per) + pos
        short = np.concatenate([text >> K.U64(48), np.zeros(3, K.U64)])
        n = len(text)
        code = (short[:n] << K.U64(48)) | (short[1 : n + 1] << K.U64(32)) | (short[2 : n + 2] << K.U64(16)) | short[3 : n + 3]
        window = K.span_hash(K.prefix(text, K._WBASE), at, at + depth, K._WBASE)
        probe = cls(depth, code, at[:0], at[:0], window[:0])
        k = probe.key(0, at)
        order = np.argsort(k, kind="stable")
        k = k[order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        where = np.arange(len(order))
        for j in range(1, probe.rounds + 1):
            tied = ~new[where]
            tied[:-1] |= tied[1:] & (np.diff(where) == 1)
            where = where[tied]
            if not len(where):
                break
            group = np.cumsum(new[where])
            mine = order[where]
            k = probe.key(j, at[mine]) if j < probe.rounds else window[mine]
            sub = np.lexsort((k, group))
            order[where] = mine[sub]
            k, group = k[sub], group[sub]
            new[where] = np.concatenate([[True], (k[1:] != k[:-1]) | (group[1:] != group[:-1])])
        doc = np.repeat(np.array(ids, np.int64), per)[order]
        head = np.flatnonzero(new)
        level = cls(depth, code, at[order[head]], np.minimum.reduceat(doc, head) if len(head) else doc, window[order[head]])
        return level, doc, pos[order], np.cumsum(new) - 1

    def find(self, other: "Level") -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each of the other's windows; the place of one that isn't is where it belongs."""
        low, high = np.searchsorted(self.first, other.first, "left"), np.searchsorted(self.first, other.first, "right")
        live = np.flatnonzero(low < high)
        for j in range(1, self.rounds + 1):
            if not len(live):
                break
            if j < self.rounds:
                mine, want = (lambda i, j=j: self.key(j, self.at[i])), other.key(j, other.at[live])
            else:
                mine, want = (lambda i: self.window[i]), other.window[live]
            a, b = low[live], high[live]
            low[live] = a = _search(mine, want, a, b, False)
            high[live] = b = _search(mine, want, a, b, True)
            live = live[a < b]
        return low, low < high

    def merged(self, other: "Level", place: np.ndarray, there: np.ndarray) -> "Level":
        """The windows of both, the other's documents being larger; place and there are of find(other)."""
        new = np.flatnonzero(~there)
        n = len(self) + len(new)
        theirs = place[new] + np.arange(len(new))
        ours = np.ones(n, bool)
        ours[theirs] = False
        fields = []
        for name in self.FIELDS:
            a, b = getattr(self, name), getattr(other, name)[new]
            out = np.empty(n, a.dtype)
            out[ours], out[theirs] = a, b + len(self.code) if name == "at" else b
            fields.append(out)
        return Level(self.depth, np.concatenate([self.code, other.code]), *fields)


def _search(key, want: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """For each range low .. high of sorted keys, the first place whose key isn't under (or, after: is over) the wanted one."""
    low, high = low.copy(), high.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) >> 1
        k = key(mid)
        right = (k <= want[live]) if after else (k < want[live])
        low[live[right]] = mid[right] + 1
        high[live[~right]] = mid[~right]
        live = live[low[live] < high[live]]
    return low


class Family:
    """Levels of geometrically growing size.  add() gives what a batch repeats of earlier batches or of itself."""

    def __init__(self, depth: int = MIN_WORDS, unit: int = BATCH_WORDS):
        self.depth, self.unit, self.levels = depth, unit, []
        self.sorted = self.moved = 0  # suffixes sorted, and merged, so far

    def size_class(self, level: Level) -> int:
        return max(0, (len(level) // self.unit).bit_length())

    def add(self, ids: list[int], words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, position, smallest earlier document with the same window); batches come in the order of ids."""
        batch, doc, pos, window = Level.of(ids, words, self.depth)
        self.sorted += len(doc)
        least, found = batch.doc.copy(), None
        for level in self.levels:
            found = place, there = level.find(batch)
            least[there] = np.minimum(least[there], level.doc[place[there]])
        least = least[window]
        hit = least < doc
        if len(batch):
            while self.levels and self.size_class(self.levels[-1]) <= self.size_class(batch):
                last = self.levels.pop()
                batch = last.merged(batch, *(found or last.find(batch)))  # the last level was searched last
                self.moved += len(batch)
                found = None
            self.levels.append(batch)
        return doc[hit], pos[hit], least[hit]


def repeats(table: pa.Table, depth: int, unit: int) -> pa.Table:
    table = B.by_id(table)
    ids = table.column("doc_id").to_numpy().tolist()
    words: list[np.ndarray] = []
    for _, piece in K.pieces(B.one(table.column("text"))):
        w = K.Words(piece)
        words += [w.hash[w.first[k] : w.first[k + 1]] for k in range(len(piece))]
    family, found, at = Family(depth, unit), [], 0
    while at < len(ids):
        to, held = at, 0
        while to < len(ids) and (to == at or held + len(words[to]) <= unit):
            held += len(words[to])
            to += 1
        found.append(family.add(ids[at:to], words[at:to]))
        at = to
    d, p, m = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    if not len(d):
        return pa.table({"doc_id": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "end": pa.array([], pa.int64()), "match_doc": pa.array([], pa.int64())})
    order = np.lexsort((p, d))
    d, p, m = d[order], p[order], m[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (np.diff(p) > depth)]))
    last = np.concatenate([new[1:], [len(d)]]) - 1
    return pa.table({"doc_id": d[new], "start": p[new], "end": p[last] + depth, "match_doc": np.minimum.reduceat(m, new)})


def _spans(docs: DataFrame, min_words: int, unit: int, most: int, split: int) -> DataFrame:
    parts = B.partitions(docs)
    every = lambda doc, anchor, n, size: n >= 1
    link = B.exploded(B.cut(B.regroup(B.linked(docs, seeds(SEED_K, WINDOW), split), every)))
    hot = link.groupBy("anchor").agg(F.sum("size").alias("w")).filter(F.col("w") > most).select("anchor").checkpoint()
    run = lambda t: repeats(t, min_words, unit)
    schema = "doc_id long, start long, end long, match_doc long"
    if hot.isEmpty():
        return B.gather(docs, link, 4 * parts, most).groupBy(*B.CELL).applyInArrow(run, schema)
    cold = link.join(hot, "anchor", "left_anti")
    crowd = docs.join(link.join(hot, "anchor", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi")
    whole = B.cut(B.regroup(B.linked(crowd, seeds(min_words, 1), split), every))
    star = B.gather(docs, B.exploded(whole), 4 * parts, most * (WINDOW + 1) // 2, star=True).groupBy(*B.CELL).applyInArrow(run, schema)
    return B.gather(docs, cold, 4 * parts, most).groupBy(*B.CELL).applyInArrow(run, schema).unionByName(star)


def long_repeats(docs: DataFrame, min_words: int = MIN_WORDS, unit: int = BATCH_WORDS, most: int = MOST, share: int = B.SHARE) -> DataFrame:
    """Parts of documents, of min_words or more, that earlier documents hold (see the module's text)."""
    if min_words < SEED_K + WINDOW - 1:
        raise ValueError(f"min_words must be at least {SEED_K + WINDOW - 1}: shorter repeats may share no seed")
    shared_checkpoints(docs.sparkSession)
    spans = _spans(B.texts(docs), min_words, unit, most, B.shares(docs, share))
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = spans.withColumn("far", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    run = reach.withColumn("run", F.sum(F.when(F.col("start") <= F.col("far"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("match_doc").alias("match_doc")).select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("length"), "match_doc")
