"""Operator 6: toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is read as its character n-grams of 3 to 5 characters, its two ends
marked, hashed into BUCKETS.  The mean of the n-grams' vectors over the distinct
words of a window of WINDOW words, taken with SMOOTH neutral ones so that a
window of one repeated word is no extreme, goes through a linear softmax; vectors and weights are trained
together (stochastic gradient, small batches), so that words never seen in training, such as
misspelt insults, score by the n-grams they share with known ones.  A document
is split into windows that cover all of it and scores as its worst window:
a long text doesn't dilute what it says.

As the network is linear after averaging, vectors and weights fold into one
number for each bucket; scoring is then a gather and a sum over whole columns.

Fitting uses at most MAX_LABELLED labelled documents, chosen by the hash of
their id, and of those at most MAX_WINDOWS windows, half of them of each class
and drawn over all its documents in turn; a fifth of the documents is held out,
and the decision threshold is the middle between the smallest score from which
precision is MIN_PRECISION there and the next one, LEAST_SCORE at least.

Defined cases: null or empty texts score 0 and are not toxic; texts of any
length are scored whole; rows without an id are scored, with a null id; labels
that are null are not used, and of several for one id the toxic one counts; with
no labelled toxic (or no clean) document, or an empty table of labels, nothing is
called toxic; a text of which no n-gram was met in fitting is not toxic; of rows
that repeat an id each is scored by itself; scores equal to the threshold are
toxic; other columns are ignored by toxic_documents and kept by without_toxic; an
empty table of documents gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K

BUCKETS, SIZES, DIM = 1 << 18, (3, 4, 5), 4  # the training packs a bucket into 18 bits
WINDOW = 32
MAX_LABELLED, MAX_WINDOWS = 4000, 40000
EPOCHS, BATCH, RATE = 10, 64, 0.05
FIT_BYTES = 1 << 17  # text held as n-grams of 8 bytes at a time
SMOOTH, SCALE = 100, 20.0  # means over hundreds of n-grams are small
MIN_PRECISION = 0.95
LEAST_SCORE = 0.3


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, window of each code, first window of each row): the distinct lower-case words of each window as code points, a 0 before and after each."""
    words = K.Words(column)
    counts = words.counts()
    edge = np.concatenate([[0], np.cumsum(-(-counts // WINDOW))])
    if not len(words.start):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), edge
    row = words.rows()
    window = edge[row] + (np.arange(len(row)) - words.first[row]) // WINDOW
    key = (window.astype(np.uint64) << np.uint64(44)) | (words.hash >> np.uint64(20))
    order = np.argsort(key)
    keep = order[np.concatenate([[True], np.diff(key[order]) > 0])]
    keep.sort()
    window = window[keep]
    n = len(keep)
    raw = words.raw
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    start, end = heads[words.start[keep]], heads[words.end[keep]]
    length = end - start
    out = np.zeros(int(length.sum()) + n + 1, np.uint32)
    offset = np.cumsum(length) - length + np.arange(n) + 1
    within = K.expand(length)
    out[np.repeat(offset, length) + within] = codes[np.repeat(start, length) + within]
    of = np.repeat(window, length + 1)
    return out, np.concatenate([of, [window[-1]]]), edge


def subwords(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, window, first window of each row) of every character n-gram."""
    codes, window, edge = characters(column)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), edge
    pre = K.prefix(codes.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15)
    gaps = np.concatenate([[0], np.cumsum(codes == 0)])
    buckets, windows = [], []
    for n in SIZES:
        i = np.arange(len(codes) - n + 1)
        i = i[gaps[i + n - 1] == gaps[i + 1]]  # no end of a word within
        h = K.span_hash(pre, i, i + n, 0x9E3779B97F4A7C15)
        buckets.append((h >> np.uint64(46)).astype(np.int64))
        windows.append(window[i + 1])  # the second code is in the word
    return np.concatenate(buckets), np.concatenate(windows), edge


@dataclass(frozen=True)
class Model:
    """Folded weights: a window's score is sigmoid(bias + the mean of its n-grams' weights)."""

    weight: np.ndarray
    bias: float
    threshold: float

    def score(self, column: pa.Array) -> np.ndarray:
        """The highest toxic probability of any window, for each row."""
        out = np.zeros(len(column))
        for at, piece in K.pieces(column, FIT_BYTES):
            bucket, window, edge = subwords(piece)
            total = int(edge[-1])
            if total:
                n = np.bincount(window, minlength=total)
                s = np.bincount(window, weights=self.weight[bucket], minlength=total)
                p = np.where(n > 0, 1 / (1 + np.exp(-np.clip(self.bias + s / (n + SMOOTH), -50, 50))), 0.0)
                has = np.flatnonzero(np.diff(edge))
                out[at + has] = np.maximum.reduceat(p, edge[has])
        return out


def train(texts: list[str], toxic: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight by bucket, bias) fitted to windows of the texts."""
    column = pa.array(texts, pa.large_string())
    # Windows are drawn by their counts first, so that only the drawn ones are held, as flat arrays.
    counts = np.concatenate([-(-K.Words(piece).counts() // WINDOW) for _, piece in K.pieces(column)])
    doc = np.repeat(np.arange(len(texts)), counts)
    rng = np.random.default_rng(seed)
    mixed = rng.permutation(len(doc))
    by_doc = np.argsort(doc[mixed], kind="stable")
    turn = np.empty(len(doc), np.int64)  # of a window among its document's
    turn[by_doc] = K.expand(counts)
    even = mixed[np.argsort(turn, kind="stable")]
    classes = [even[toxic[doc[even]] == c] for c in (0, 1)]
    # Each class has half of the room, and what the other leaves; windows are taken from all its documents in turn.
    most = min(len(classes[1]), max(MAX_WINDOWS // 2, MAX_WINDOWS - len(classes[0])))
    drawn = np.zeros(len(doc), bool)
    drawn[classes[1][:most]] = drawn[classes[0][: MAX_WINDOWS - most]] = True
    mixed = mixed[drawn[mixed]]
    chosen = np.concatenate([mixed[toxic[doc[mixed]] == 1], mixed[toxic[doc[mixed]] == 0]])
    place = np.full(len(doc), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    doc = doc[chosen]
    y = toxic[doc].astype(np.int64)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    base, seen = 0, np.zeros(BUCKETS, np.int64)
    for _, piece in K.pieces(column, FIT_BYTES):
        bucket, window, edge = subwords(piece)
        at = place[base + window]
        key, n = np.unique((at[at >= 0].astype(np.int64) << 18) | bucket[at >= 0], return_counts=True)
        total = np.bincount(key >> 18, weights=n, minlength=1)
        held.append(((key & (BUCKETS - 1)).astype(np.int32), (n / (total[key >> 18] + SMOOTH)).astype(np.float32), (key >> 18).astype(np.int32)))
        seen += np.bincount(held[-1][0], minlength=BUCKETS)
        base += int(edge[-1])
    kept = int(seen[seen > 2].sum())
    flat, share = np.empty(kept, np.int32), np.empty(kept, np.float32)
    begin, size = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
    end = 0
    while held:
        f, v, owner = held.pop()
        m = seen[f] > 2
        f, v, owner = f[m], v[m], owner[m]
        flat[end : end + len(f)], share[end : end + len(f)] = f, v
        which, first, n = np.unique(owner, return_index=True, return_counts=True)
        begin[which], size[which] = first + end, n
        end += len(f)
    table = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    start = table.copy()
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    active = np.arange(len(y))

    def forward(ids):
        n = size[ids]
        at = np.repeat(begin[ids], n) + K.expand(n)
        f, v, r = flat[at], share[at] * SCALE, np.repeat(np.arange(len(ids)), n)
        hidden = np.stack([np.bincount(r, weights=table[f, d] * v, minlength=len(ids)) for d in range(DIM)], 1).astype(np.float32)
        z = hidden @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        return f, v, r, hidden, p / p.sum(1, keepdims=True)

    for epoch in range(EPOCHS):
        if epoch and epoch % 2 == 0 and epoch <= EPOCHS // 2:
            # A toxic document needs one toxic window: its others leave unless they look toxic too.
            p = np.concatenate([forward(np.arange(s, min(s + BATCH, len(y))))[4][:, 1] for s in range(0, len(y), BATCH)])
            best = np.zeros(len(toxic))
            np.maximum.at(best, doc, p)
            active = np.flatnonzero((y == 0) | (p >= np.minimum(best[doc], 0.5)))
        order = rng.permutation(active)
        for s in range(0, len(order), BATCH):
            ids = order[s : s + BATCH]
            f, v, r, hidden, g = forward(ids)
            if not len(f):
                continue
            g[np.arange(len(ids)), y[ids]] -= 1
            back = (g @ soft.T).astype(np.float32)
            soft -= RATE / 20 * (hidden.T @ g).astype(np.float32)
            bias -= RATE / 20 * g.sum(0).astype(np.float32)
            u, inv = np.unique(f, return_inverse=True)
            table[u] -= RATE * np.stack([np.bincount(inv, weights=back[r, d] * v, minlength=len(u)) for d in range(DIM)], 1).astype(np.float32)
    moved = (table != start).any(1)
    direction = soft[:, 1] - soft[:, 0]
    weight = np.where(moved, (table @ direction) * SCALE, 0.0)  # n-grams never met say nothing
    return weight.astype(np.float64), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """A model fitted to at most `most` labelled documents (see the module's text)."""
    sample = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("label")).filter("label_id is not null and label is not null")
    sample = sample.groupBy("label_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    data = met.select("doc_id", "text", "label", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).alias("held")).toPandas()
    data = data.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
    none = Model(np.zeros(BUCKETS), -50.0, 1.0)
    rest, held = data[~data["held"]], data[data["held"]]
    if rest["label"].nunique() < 2:
        return none
    weight, bias = train(rest["text"].tolist(), rest["label"].to_numpy())
    model = Model(weight, bias, 0.5)
    ref = held if held["label"].nunique() == 2 else rest
    p, y = model.score(pa.array(ref["text"].tolist(), pa.large_string())), ref["label"].to_numpy()
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.concatenate([p[order][1:] != p[order][:-1], [True]])  # a threshold can't part equal scores
    good = np.flatnonzero(ends & (right >= MIN_PRECISION))
    if not len(good):
        return none
    last = good[-1]
    below = p[order][last + 1] if last + 1 < len(p) else 0.0
    unknown = 1 / (1 + np.exp(-np.clip(bias, -50, 50)))  # the score of a text of which nothing was met
    return Model(weight, bias, float(max((p[order][last] + below) / 2, LEAST_SCORE, unknown + 1e-6)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, toxic) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= model.threshold)], ["doc_id", "score", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, toxic boolean")


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that a model fitted to the labels calls toxic, with their scores."""
    return scored(docs, fit(docs, labels)).filter("toxic")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the toxic rows, in one pass: columns, rows without text and order of columns stay."""
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(at)) < model.threshold))

    return docs.mapInArrow(run, docs.schema)
