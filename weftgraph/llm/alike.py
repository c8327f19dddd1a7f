"""All pairs of different texts that may share a passage, for operator 1.

A passage here is `words` words on one diagonal of two texts, of which `most`
at most differ.  Such a window has `least` equal k-mers at least (each
differing word spoils k), and no pair that has one is left out:

1. The n-th occurrence of a k-mer in a text is a feature of its own, so a pair
   with such a window shares `least` features, even if its words repeat.
2. Features that up to COLD texts hold link all their holders.  Pairs that
   share `least` of them are kept.
3. Any other window holds a k-mer of over COLD texts.  Each occurrence of those
   is sent to the k-mer's bucket with the words around it, 8 bits for each.  The
   rest of the window, cut into pairs of words on both sides of the k-mer, has
   more equal pairs of words than half; so the most common places, as many as
   a window can do without, are left (the rest of a popular line, mostly), and
   occurrences that agree in one of the others are counted word by word.  Where
   the k-mer before is as popular and equal too, the pair is found there.

Hashes that clash add pairs and lose none, but for the 64 bits that stand for a
text and for a k-mer of a text.  Equal texts are one text throughout.

``found`` tells pairs with a window apart from those that may have one: of the
windows of 3., words of which SURE more than needed seem to be equal are enough
(that 8 bits of over SURE differing words of a window clash has odds of about 1
in 10 million); the others, and those of 2., are left to be looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import blocks as B
from weftgraph.llm import kernels as K
from weftgraph.llm.ngram_jaccard import _roots

U64 = np.uint64
#: Holders up to which all pairs of a feature's holders are linked.
COLD = 32
#: Occurrences up to which all pairs of a bucket's k-mer are counted, and pairs that are counted at once.
FEW, AT_ONCE = 64, 1 << 17
#: Equal words beyond those needed that settle a window of which 8 bits a word are known.
SURE = 3
#: Links that stand for a window that is sure.
SETTLED = 1 << 24
PAIRS = "target int, data binary"


class Rule:
    """Windows of `words` words of which `most` may differ, and k-mers."""

    def __init__(self, words: int, most: int, k: int):
        self.words, self.most, self.k = words, most, k
        self.least = words - k + 1 - k * most
        self.side = words - k  # words around a k-mer that a window with it may hold
        self.side += self.side % 2
        # Whole pairs of words of a window beside the k-mer, and how many of them may be left out.
        self.spare = (words - k - 2) // 2 - most - 1
        if self.least < 1 or self.spare < 0:
            raise ValueError("windows that differ so much have no seed in common")


def names(words: K.Words) -> np.ndarray:
    """64 bits for the words of each row; equal texts have equal ones."""
    return K.mix(K.span_hash(K.prefix(words.hash, K._WBASE), words.first[:-1], words.first[1:], K._WBASE) ^ K.mix(words.counts().astype(U64))).view(np.int64)


def digests(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, name, size) of the texts of at least `words` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, piece in K.pieces(batch.column(1)):
                w = K.Words(piece)
                n = w.counts()
                there = np.flatnonzero(n >= words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(piece)).take(pa.array(there)), pa.array(names(w)[there]), pa.array(n[there].astype(np.int64))], ["doc_id", "name", "size"])

    return docs.mapInArrow(run, "doc_id long, name long, size long")


def occurrences(rule: Rule) -> B.Feature:
    """The k-mers of texts that are long enough; the second and later of one text are features of their own."""

    def feature(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
        h, row, _ = K.ngrams(words, rule.k, short=False)
        long = words.counts()[row] >= rule.words
        h, row = h[long], row[long]
        with np.errstate(over="ignore"):
            key = K.mix(h + (row.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
            order = np.argsort(key)
            key = key[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            nth = np.arange(len(key)) - np.repeat(start, np.diff(np.concatenate([start, [len(key)]])))
            again = np.flatnonzero(nth)
            h[order[again]] = K.mix(h[order[again]] + nth[again].astype(U64) * U64(0xD1342543DE82EF95))
        return h, row

    return feature


def _thin(table: pa.Table, split: int) -> pa.Table:
    """Of a feature in a share, COLD + 1 holders, which show as well that it has too many."""
    h, where, ids, sizes = B.unpack(table.column("data").to_pylist())
    bucket = int(table.column("bucket")[0].as_py()) // split
    known, number = np.unique(ids, return_inverse=True)
    key = K.distinct((h << U64(32)) | number[where].astype(U64))
    _, start = B._firsts(key >> U64(32))
    nth = np.arange(len(key)) - np.repeat(start, np.diff(np.concatenate([start, [len(key)]])))
    key = key[nth <= COLD]
    place = (key & U64(0xFFFFFFFF)).astype(np.uint32)
    body = np.array([len(known), len(key)], np.uint32).tobytes() + K.plane(known) + K.plane((key >> U64(32)).astype(np.uint32)) + K.plane(place)
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "data": pa.array([body], pa.binary())})


def _thinned(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, names) of the blocks of _thin, sorted and distinct."""
    tops, ids = [], []
    for b in blocks:
        d, n = (int(x) for x in np.frombuffer(b, np.uint32, count=2))
        mine, at = K.unplane(b[8 : 8 + 8 * d], d, np.int64), 8 + 8 * d
        tops.append(K.unplane(b[at : at + 4 * n], n, np.uint32).astype(U64))
        ids.append(mine[K.unplane(b[at + 4 * n : at + 8 * n], n, np.uint32)])
    known, number = np.unique(np.concatenate(ids), return_inverse=True)
    key = K.distinct((np.concatenate(tops) << U64(32)) | number.astype(U64))
    return key >> U64(32), (key & U64(0xFFFFFFFF)).astype(np.int64), known


def _sent(first: np.ndarray, second: np.ndarray, n: np.ndarray, targets: int, shift: int = 0) -> pa.Table:
    """Packed rows (first, second, n) by target, which follows `first`."""
    target = (K.mix(first.view(U64)) % U64(targets)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    first, second, n, target = first[order], second[order], n[order], target[order]
    out_t, out_b = [], []
    for s, e in zip(*B._runs(target)):
        out_t.append(int(target[s]) + shift)
        out_b.append(np.uint32(e - s).tobytes() + K.plane(first[s:e]) + K.plane(second[s:e]) + K.plane(n[s:e].astype(np.uint32)))
    return pa.table({"target": pa.array(out_t, pa.int32()), "data": pa.array(out_b, pa.binary())})


def _received(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cols: list[list] = [[], [], []]
    for b in blocks:
        m, at = int(np.frombuffer(b, np.uint32, count=1)[0]), 4
        for c, kind in zip(cols, (np.int64, np.int64, np.uint32)):
            size = m * np.dtype(kind).itemsize
            c.append(K.unplane(b[at : at + size], m, kind))
            at += size
    return tuple(np.concatenate(c) for c in cols)


def _cold(table: pa.Table, targets: int, thin: bool) -> pa.Table:
    """Links of the features of few texts by target; of the others (name, k-mer) by targets + target, or if thin (k-mer, k-mer) by 2 * targets."""
    blocks, bucket = table.column("data").to_pylist(), int(table.column("bucket")[0].as_py())
    top, doc, known = _thinned(blocks) if thin else B._holders(table)[:3]
    _, start = B._firsts(top)
    length = np.diff(np.concatenate([start, [len(top)]]))
    made = [np.zeros(0, U64)]
    for n in np.unique(length[(length > 1) & (length <= COLD)]).tolist():
        at, (i, j) = start[length == n][:, None], np.triu_indices(n, 1)
        made.append(((doc[at + j].astype(U64) << U64(32)) | doc[at + i].astype(U64)).ravel())
    pair, n = np.unique(np.concatenate(made), return_counts=True)
    out = _sent(known[(pair >> U64(32)).astype(np.int64)], known[(pair & U64(0xFFFFFFFF)).astype(np.int64)], n, targets)
    hot = length > COLD
    code = (U64(bucket) << U64(32)).astype(U64) | top
    if thin:
        code = code[start[hot]].view(np.int64)
        more = pa.table({"target": pa.array([2 * targets + bucket], pa.int32()), "data": pa.array([code.tobytes()], pa.binary())})
    else:
        held = np.repeat(hot, length)
        more = _sent(known[doc[held]], code[held].view(np.int64), np.zeros(int(held.sum())), targets, targets)
    return pa.concat_tables([out, more])


def _held(table: pa.Table, hot: pa.Table, split: int, targets: int) -> pa.Table:
    """(name, k-mer) of the texts of a share that hold k-mers of `hot`."""
    if not table.num_rows or not hot.num_rows:
        return _sent(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), targets)
    top, doc, known, _ = B._holders(table)
    code = ((U64(int(table.column("bucket")[0].as_py()) // split) << U64(32)) | top).view(np.int64)
    held = np.isin(code, np.frombuffer(b"".join(hot.column("data").to_pylist()), np.int64))
    return _sent(known[doc[held]], code[held], np.zeros(int(held.sum())), targets, targets)


def _popular(table: pa.Table) -> pa.Table:
    """(name, kmers): the k-mers of many texts that a text holds."""
    name, code, _ = _received(table.column("data").to_pylist())
    order = np.lexsort((code, name))
    name, code = name[order], code[order]
    s, _ = B._runs(name)
    return pa.table({"name": pa.array(name[s]), "kmers": pa.ListArray.from_arrays(pa.array([*s, len(name)], pa.int32()), pa.array(code))})


def contexts(held: DataFrame, rule: Rule, buckets: int, split: int) -> DataFrame:
    """(cell, data): packed (k-mer, text, k-mer before if it is one of many texts too, words around) of (name, text, kmers)."""
    k, side = rule.k, rule.side
    offsets = np.concatenate([np.arange(-side, 0), np.arange(k, k + side)])

    def pack(code, name, before, around) -> pa.RecordBatch:
        cell = (code >> 32) * split * split
        if split > 1:  # texts fall into parts, and each two parts have a cell
            part = (K.mix(name.view(U64) ^ U64(0x51A2E)) % U64(split)).astype(np.int64)
            each, other = np.repeat(np.arange(len(code)), split), np.tile(np.arange(split), len(code))
            cell = cell[each] + np.minimum(part[each], other) * split + np.maximum(part[each], other)
            code, name, before, around = code[each], name[each], before[each], around[each]
        order = np.argsort(cell, kind="stable")
        code, name, before, around, cell = (x[order] for x in (code, name, before, around, cell))
        out_c, out_b = [], []
        for s, e in zip(*B._runs(cell)):
            out_c.append(int(cell[s]))
            out_b.append(np.uint32(e - s).tobytes() + K.plane(code[s:e]) + K.plane(name[s:e]) + K.plane(before[s:e]) + around[s:e].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out_c, pa.int64()), pa.array(out_b, pa.binary())], ["cell", "data"])

    def of(piece: pa.Array, name: np.ndarray, popular: np.ndarray):
        w = K.Words(piece)
        h, row, pos = K.ngrams(w, k, short=False)
        code = ((((h >> U64(32)) % U64(buckets)) << U64(32)) | (h & U64(0xFFFFFFFF))).view(np.int64)
        place = np.minimum(np.searchsorted(popular, code), len(popular) - 1)
        hot = popular[place] == code
        before = np.where(np.concatenate([[False], hot[:-1]]) & (pos > 0), np.concatenate([[0], code[:-1]]), 0) if len(code) else code
        word = (w.hash >> U64(40)) % U64(255)
        word = (word + U64(1)).astype(np.uint8)  # 0 is no word
        found = np.flatnonzero(hot)
        for s in range(0, len(found), 1 << 14):
            at = found[s : s + (1 << 14)]
            r = row[at]
            where = (w.first[r] + pos[at])[:, None] + offsets
            inside = (where >= w.first[r][:, None]) & (where < w.first[r + 1][:, None])
            around = np.where(inside, word[np.clip(where, 0, len(word) - 1)], 0).astype(np.uint8)
            # A text that goes round in circles has few different ones.
            with np.errstate(over="ignore"):
                mark = around.astype(U64) @ K.powers(K._WBASE, around.shape[1])[0][1 : around.shape[1] + 1]
                mark = K.mix(K.mix(K.mix(mark) + code[at].view(U64)) + before[at].view(U64)) + K.mix(r.astype(U64))
            _, one = np.unique(mark, return_index=True)
            yield code[at][one], name[r[one]], before[at][one], around[one]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            name = batch.column(0).to_numpy(zero_copy_only=False)
            values, at = B.lists(batch.column(2))
            for first, piece in K.pieces(batch.column(1)):
                for x in of(piece, name[first : first + len(piece)], K.distinct(values[at[first] : at[first + len(piece)]])):
                    waiting.append(x)
                    n += len(x[0]) * split
                    if n >= 1 << 17:
                        yield pack(*(np.concatenate(c) for c in zip(*waiting)))
                        waiting, n = [], 0
        if waiting:
            yield pack(*(np.concatenate(c) for c in zip(*waiting)))

    return held.mapInArrow(run, "cell long, data binary")


def windows(a: np.ndarray, b: np.ndarray, rule: Rule, more: int = 0) -> np.ndarray:
    """Whether the words around a k-mer agree in all but `most` words of a window with it, and in `more` of those."""
    out = np.zeros(len(a), bool)
    need, side = rule.words - rule.most - rule.k + more, rule.side
    same = (a == b) & (a > 0)
    some = np.flatnonzero(np.count_nonzero(same, axis=1) >= need)
    if len(some):
        same, rest = same[some], rule.words - rule.k
        left = np.zeros((len(some), side + 1), np.int16)
        right = left.copy()
        np.cumsum(same[:, :side][:, ::-1], axis=1, out=left[:, 1:])
        np.cumsum(same[:, side:], axis=1, out=right[:, 1:])
        out[some] = (left[:, : rest + 1] + right[:, rest::-1][:, : rest + 1]).max(axis=1) >= need
    return out


def alike(name: np.ndarray, before: np.ndarray, around: np.ndarray, rule: Rule, part: np.ndarray | None) -> np.ndarray:
    """Pairs (i << 32 | j) of the occurrences of one k-mer that lie in a common window, but for those that are found at the k-mer before."""
    n = len(name)
    if (before == before[0]).all() and before[0]:
        return np.zeros(0, U64)

    text = np.unique(name, return_inverse=True)[1]
    known = np.zeros(0, np.int64)  # pairs of texts that are found

    def both(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.minimum(text[i], text[j]) << 32 | np.maximum(text[i], text[j])

    def new(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(known) and len(i):
            pair = both(i, j)
            there = known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] == pair
            i, j = i[~there], j[~there]
        return i, j

    def good(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """One of the pairs (i, j) for each two texts that aren't known yet; a text may have a k-mer thousands of times."""
        nonlocal known
        ok = (name[i] != name[j]) & ((before[i] != before[j]) | (before[i] == 0))
        if part is not None:
            ok &= part[i] != part[j]
        i, j = i[ok], j[ok]
        out, step = [np.zeros(0, U64)], 0
        while len(i):
            # First one occurrence of each pair of texts, then the others of those that it didn't settle, in slices.
            at = np.unique(both(i, j), return_index=True)[1] if not step else np.arange(min(len(i), AT_ONCE))
            for s in range(0, len(at), AT_ONCE):
                x, y = i[at[s : s + AT_ONCE]], j[at[s : s + AT_ONCE]]
                ok = windows(around[x], around[y], rule)
                x, y = x[ok], y[ok]
                if len(x):
                    pair, one = np.unique(both(x, y), return_index=True)
                    out.append((x[one].astype(U64) << U64(32)) | y[one].astype(U64))
                    known = K.distinct(np.concatenate([known, pair]))
            rest = np.ones(len(i), bool)
            rest[at] = False
            i, j = new(i[rest], j[rest])
            step += 1
        return np.concatenate(out)

    if n <= FEW:
        return good(*np.triu_indices(n, 1))
    # Texts with equal words after the k-mer are pairs, without a look at each; the groups of most texts get one label each.
    found, label = [np.zeros(0, U64)], text.copy()
    whole = np.flatnonzero((before == 0) & (around[:, rule.side :] > 0).all(axis=1))
    if len(whole):
        with np.errstate(over="ignore"):
            mark = np.unique(around[whole, rule.side :].astype(U64) @ K.powers(K._WBASE, rule.side)[0][1 : rule.side + 1], return_inverse=True)[1]
        one = np.unique((mark << 32) | text[whole], return_index=True)[1]
        mark, whole = mark[one], whole[one]
        many = np.bincount(mark)[mark]
        order = np.lexsort((mark, -many, text[whole]))
        best = order[np.concatenate([[True], np.diff(text[whole][order]) > 0])]
        best = best[np.argsort(mark[best], kind="stable")]
        for s, e in zip(*B._runs(mark[best])):
            if e - s >= 8:
                one = whole[best[s:e]]
                label[np.isin(text, text[one])] = n + s
                x, y = np.triu_indices(len(one), 1)
                x, y = one[x], one[y]
                if part is not None:
                    x, y = x[part[x] != part[y]], y[part[x] != part[y]]
                found.append((x.astype(U64) << U64(32)) | y.astype(U64))
                known = np.concatenate([known, both(x, y)])
        known = K.distinct(known)
    half = rule.side // 2
    kind = np.unique(before, return_inverse=True)[1]

    def place(c: int, by: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The occurrences by two words at place c, where the partners of each begin, and how many it has: those before, of equal words, that differ in `by`, or all if it is free."""
        x, y = around[:, 2 * c], around[:, 2 * c + 1]
        item = np.flatnonzero((x > 0) & (y > 0))
        two = (x[item].astype(np.int64) << 8) | y[item]
        order = np.argsort((two << 40) | by[item], kind="stable")
        item, two = item[order], two[order]
        fresh = np.concatenate([[True], two[1:] != two[:-1]]) if len(item) else np.zeros(0, bool)
        turn = fresh | np.concatenate([[True], by[item][1:] != by[item][:-1]]) if len(item) else fresh
        count = np.arange(len(item))
        start, until = (np.maximum.accumulate(np.where(f, count, 0)) for f in (fresh, turn))
        return item, start, np.where(free[item], count, until) - start

    # Those with the same k-mer before needn't meet, nor those of one label: what leaves less is taken.
    ways = [(kind, before == 0), (label, np.zeros(n, bool))]
    costs = [np.array([int(place(c, *way)[2].sum()) for c in range(2 * half)]) for way in ways]
    cost, way = min(zip(costs, ways), key=lambda x: int(x[0].sum()))
    left, right = np.zeros(half + 1, np.int64), np.zeros(half + 1, np.int64)  # places left out of the first i on each side
    out = np.zeros(2 * half, bool)
    for c in np.argsort(-cost, kind="stable").tolist():
        l, r = left.copy(), right.copy()
        (l if c < half else r)[(half - c if c < half else c - half + 1) :] += 1
        if (l + r[::-1]).max() <= rule.spare:
            left, right, out[c] = l, r, True
    for c in np.flatnonzero(~out & (cost > 0)).tolist():
        item, start, many = place(c, *way)
        total, at = np.cumsum(many), 0
        while at < len(many):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, side="right")))
            m = many[at:to]
            found.append(good(*new(np.repeat(item[at:to], m), item[np.repeat(start[at:to], m) + K.expand(m)])))
            at = to
    return np.concatenate(found)


def _met(table: pa.Table, rule: Rule, targets: int, split: int, apart: bool) -> pa.Table:
    """Links of the pairs in a common window by target; if `apart`, of those that surely are by targets + target."""
    cols: list[list] = [[], [], [], []]
    for b in table.column("data").to_pylist():
        m, at = int(np.frombuffer(b, np.uint32, count=1)[0]), 4
        for c in cols[:3]:
            c.append(K.unplane(b[at : at + 8 * m], m, np.int64))
            at += 8 * m
        cols[3].append(np.frombuffer(b, np.uint8, offset=at).reshape(m, 2 * rule.side))
    code, name, before, around = (np.concatenate(c) for c in cols)
    order = np.argsort(code, kind="stable")
    code, name, before, around = code[order], name[order], before[order], around[order]
    cell, part = int(table.column("cell")[0].as_py()) % (split * split), None
    if cell // split != cell % split:
        part = (K.mix(name.view(U64) ^ U64(0x51A2E)) % U64(split)).astype(np.int64)
    known, number = np.unique(name, return_inverse=True)
    made, sure = [np.zeros(0, U64)], [np.zeros(0, U64)]
    for s, e in zip(*B._runs(code)):
        if e - s > 1:
            pair = alike(name[s:e], before[s:e], around[s:e], rule, None if part is None else part[s:e])
            if len(pair):
                x, y = (pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(np.int64)
                i, j = number[s:e][x], number[s:e][y]
                pair = (np.maximum(i, j).astype(U64) << U64(32)) | np.minimum(i, j).astype(U64)
                if apart:
                    x, y = x + s, y + s
                    ok = np.concatenate([windows(around[x[at : at + AT_ONCE]], around[y[at : at + AT_ONCE]], rule, min(SURE, rule.most)) for at in range(0, len(x), AT_ONCE)])
                    sure.append(K.distinct(pair[ok]))
                    pair = pair[~ok]
                made.append(K.distinct(pair))
    pair, sure = K.distinct(np.concatenate(made)), K.distinct(np.concatenate(sure))
    out = []
    for one, links, shift in ((np.setdiff1d(pair, sure, assume_unique=True), rule.least, 0), (sure, SETTLED, targets)):
        out.append(_sent(known[(one >> U64(32)).astype(np.int64)], known[(one & U64(0xFFFFFFFF)).astype(np.int64)], np.full(len(one), links), targets, shift))
    return pa.concat_tables(out)


def _kept(table: pa.Table, least: int) -> pa.Table:
    """(a, b) of the pairs that have `least` links in all, without those that are settled."""
    a, b, n = _received(table.column("data").to_pylist())
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    if len(new):
        n = np.add.reduceat(n, new)
        new = new[(n >= least) & (n < SETTLED)]
    return pa.table({"a": a[new], "b": b[new]})


def sides(table: pa.Table) -> pa.Table:
    """(name, other, root, links): of each text of the pairs, how many it has, the smallest partner, and the smallest text that it is joined with by them."""
    a, b, _ = _received(table.column("data").to_pylist())
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    a, b = a[new], b[new]
    seen, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    links, other = np.bincount(number, minlength=len(seen)), np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(other, number, np.concatenate([b, a]))
    root = _roots(np.arange(len(seen)), number[: len(a)], number[len(a) :], seen) if len(a) else seen
    return pa.table({"name": seen, "other": other, "root": root, "links": links.astype(np.int64)})


def found(docs: DataFrame, texts: DataFrame, rule: Rule, split: int, apart: bool) -> tuple[DataFrame, DataFrame]:
    """Packed links (target, data) of features of few texts, and of windows (see _met).  docs: (doc_id, text); texts: (name, doc_id) of one document of each text."""
    parts = B.partitions(docs)
    posted = B.postings(docs, occurrences(rule), parts, split, names)
    if split == 1:
        made = B.cut(posted.groupBy("bucket").applyInArrow(lambda t: _cold(t, parts, False), PAIRS))
        held = made.filter(F.col("target") >= parts)
    else:
        thin = posted.groupBy("bucket").applyInArrow(lambda t: _thin(t, split), "bucket int, data binary")
        made = B.cut(thin.groupBy("bucket").applyInArrow(lambda t: _cold(t, parts, True), PAIRS))
        low = F.col("target") - 2 * parts
        hot = made.filter(low >= 0).select(F.explode(F.sequence(low * split, low * split + (split - 1))).alias("bucket"), "data")
        held = posted.groupBy("bucket").cogroup(hot.groupBy("bucket")).applyInArrow(lambda t, k: _held(t, k, split, parts), PAIRS)
    popular = held.groupBy("target").applyInArrow(_popular, "name long, kmers array<long>")
    popular = popular.join(texts.select("name", F.col("doc_id").alias("kept_id")), "name")
    around = contexts(docs.join(popular, F.col("doc_id") == F.col("kept_id")).select("name", "text", "kmers"), rule, parts, split)
    met = around.groupBy("cell").applyInArrow(lambda t: _met(t, rule, parts, split, apart), PAIRS)
    return made.filter(F.col("target") < parts), met


def kept(links: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): names of the pairs with links enough that aren't settled."""
    return links.groupBy(F.col("target") % B.partitions(links)).applyInArrow(lambda t: _kept(t, rule.least), "a long, b long")


def pairs(docs: DataFrame, texts: DataFrame, rule: Rule, split: int) -> DataFrame:
    """(a, b): names of each two different texts that may share a passage."""
    few, met = found(docs, texts, rule, split, False)
    return kept(few.unionByName(met), rule)
