"""Operator 5: benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names and units turn into typed
placeholders, all others stay as lower-case literals.  Windows of WIDTH
template tokens of every document are looked up by hash among the windows of
the benchmark items, so a question comes up with other numbers and names too.
Matched windows of a document and an item are aligned on their diagonal, and
the slot values there are checked: each value of the item must stand for one
value of the document, as a re-parameterised question has it and a chance match
of a common template hasn't.

A number is a word that begins with a digit (parts joined by . , : / - are one);
a name is a capitalised word inside a sentence, or a known first name, and runs
of names are one; a unit is a known unit right after a number.  A window with
literals for less than half of its tokens says little as a template: it is
looked up by its values, so that items made of numbers, names or formulas are
found where they are copied.

An item is in a document if windows cover COVER of its tokens, or LEAST tokens,
on one diagonal, with consistent slots: each value of the item stands for one
value of the document.  (Two values may become equal, as 3 and 5 may turn into 4
and 4.)  Items shorter than WIDTH are matched as a whole from SHORTEST tokens on;
still shorter ones only where they are the document's whole text, value by value.

The benchmark is read in slices of about SLICE bytes, each small enough to go to
every task, and each slice meets all documents in one pass; so its size is no
limit, and windows of the corpus are never shuffled.

Defined cases: null ids or texts on either side give nothing (in without_leaks
such rows stay); texts of any length are read whole; rows that repeat a doc_id
or item_id with the same text give one result row, with different texts the best
of them: most tokens covered, then exact ones, then the earliest, then most
slots; other columns are ignored by contaminations and kept by without_leaks; an
empty table on either side gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K

WIDTH, SHORTEST, LEAST, COVER = 8, 5, 13, 0.5
SLICE = 16_000_000
SCHEMA = "doc_id long, item_id long, start long, covered long, item_tokens long, coverage double, slots long, exact boolean"
UNITS = "kg g mg lb lbs oz km m cm mm mi mile miles metre metres meter meters foot feet inch inches yard yards hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros cent cents pound pounds percent litre litres liter liters gallon gallons mph kmh degrees watts volts centimetres centimeters millimetres millimeters kilometres kilometers kilograms kilogram grams gram milligrams tons tonnes ounces ounce celsius fahrenheit kelvin joules joule newtons pascals hertz amps ohms acres hectares cups tablespoons teaspoons pints quarts rupees yen yuan francs pesos dozen pairs points pages decades century centuries".split()
NAMES = "alice bob carol david emma frank george hannah isaac james john julia karen kevin laura linda lisa maria mary michael nancy oliver paul peter robert sarah susan thomas tom william anna ben chris daniel eve aaron adam ahmed alex alexander alexis alan albert amanda amelia amir amy andrea andrew angela anthony antonio arthur ashley barbara benjamin betty brandon brian carlos carol caroline catherine charles charlotte chloe christina christopher claire clara cynthia deborah denise dennis diana diego donald donna dorothy dylan edward elena elizabeth ella ellen emily eric erik ethan eva evelyn fatima felix fernando gabriel gary gloria grace greg gregory hans harold harry hassan heather helen henry hugo ian ibrahim irene isabella ivan jack jacob jamal jane janet jason javier jean jeff jeffrey jennifer jeremy jerry jessica jim joan joe jonathan jorge jose joseph joshua juan judith justin karl kate katherine kathleen kelly kenneth kim kyle larry lauren lena leo leon liam lily logan louis lucas lucy luis luke marcus margaret marie mark martha martin mason matthew max megan melissa mia miguel mike mohammed monica nathan nicholas nicole noah nora olivia omar oscar pablo pamela patricia patrick pedro philip priya rachel ralph raymond rebecca richard rita roberto roger ronald rosa rose roy ruth ryan sam samantha samuel sandra sara scott sean sharon simon sofia sophia sophie stella stephanie stephen steve steven stuart sue teresa theo tim timothy tony tyler victor victoria vincent walter wei wendy yusuf zoe".split()
NUM, NAME, UNIT = np.uint64(0x11), np.uint64(0x22), np.uint64(0x33)
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".?!:\n\r\"'|(-;"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9]] = True


def _known(words: list[str]) -> np.ndarray:
    return np.sort(K.Words(pa.array(words)).hash)


_UNITS, _NAMES = _known(UNITS), _known(NAMES)


def _within(values: np.ndarray, sorted_known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_known, values)
    return sorted_known[np.minimum(at, len(sorted_known) - 1)] == values


class Template:
    """Template tokens of a column: code (literal hash or placeholder), value (hash of what stood there), first[row]."""

    def __init__(self, column: pa.Array):
        seen, low = K.Words(column, lower=False), K.Words(column)
        n = len(low.hash)
        if len(seen.start) != n:
            seen = low  # lower-casing changed the words; read the lower-case text alone
        raw, start, end = seen.raw, seen.start, seen.end
        first = low.first
        if not n:
            self.code = self.value = np.zeros(0, np.uint64)
            self.first = first
            return
        head = raw[start]
        second = raw[np.minimum(start + 1, len(raw) - 1)]
        number = (head >= 48) & (head <= 57)
        upper = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        opens = np.zeros(n, bool)
        opens[first[:-1][np.diff(first) > 0]] = True
        before = np.maximum(start - 1, 0)
        spaced = _SPACE[raw[before]]
        ahead = np.where(spaced, np.maximum(start - 2, 0), before)
        name = upper & ~opens & ~_STOPS[raw[ahead]] & ~_STOPS[raw[before]]
        name |= _within(low.hash, _NAMES)
        name &= ~number
        gap = np.zeros(n, np.int64)
        gap[1:] = start[1:] - end[:-1]
        gap[opens] = 99
        joined = np.zeros(n, bool)  # goes on with the token before
        joined[1:] = (number[1:] & number[:-1] & (gap[1:] == 1) & ~spaced[1:]) | (name[1:] & name[:-1] & (gap[1:] == 1) & spaced[1:])
        after = np.zeros(n, bool)
        after[1:] = number[:-1] & (gap[1:] <= 1) & ~opens[1:]
        unit = after & _within(low.hash, _UNITS) & ~number & ~name
        keep = np.flatnonzero(~joined)
        code = np.where(number, NUM, np.where(name, NAME, np.where(unit, UNIT, low.hash)))
        pre = K.prefix(low.hash, K._WBASE)
        self.value = K.span_hash(pre, keep, np.concatenate([keep[1:], [n]]), K._WBASE)
        self.code = code[keep]
        self.first = np.searchsorted(keep, first)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, position) of all windows: of their template, or of their values where literals are too few."""
        count = np.diff(self.first)
        per = np.maximum(count - width + 1, 0)
        row = np.repeat(np.arange(len(count)), per)
        pos = K.expand(per)
        at = self.first[:-1][row] + pos
        literal = np.concatenate([[0], np.cumsum(self.code > UNIT)])
        told = (literal[at + width] - literal[at]) * 2 >= width
        h = K.span_hash(K.prefix(self.code, K._WBASE), at, at + width, K._WBASE)
        few = at[~told]
        h[~told] = self.values(few, few + width)
        return h, row, pos

    def values(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the values of tokens start .. end, other than those of any template."""
        return K.mix(K.span_hash(K.prefix(self.value, K._WBASE), start, end, K._WBASE) ^ np.uint64(0x5A17))

    def short(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """windows() of the rows that have tokens, but fewer than SHORTEST, each as a whole."""
        size = np.diff(self.first)
        row = np.flatnonzero((size > 0) & (size < SHORTEST))
        return self.values(self.first[row], self.first[row] + size[row]), row, np.zeros(len(row), np.int64)


class Items:
    """An index of benchmark items: windows by hash, and each item's template."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.template = np.array(ids, np.int64), Template(pa.array(texts, pa.large_string()))
        self.size = np.diff(self.template.first)
        self.widths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in (0, *range(SHORTEST, WIDTH + 1)):  # 0: whole texts under SHORTEST
            h, row, pos = self.template.windows(width) if width else self.template.short()
            if width:
                mine = np.minimum(self.size[row], WIDTH) == width
                h, row, pos = h[mine], row[mine], pos[mine]
            if len(h):
                order = np.argsort(h, kind="stable")
                maybe = np.zeros(1 << 20, bool)
                maybe[(h >> np.uint64(44)).astype(np.int64)] = True
                self.widths[width] = (h[order], row[order], pos[order], maybe)

    def find(self, column: pa.Array) -> list[tuple]:
        """(row of the column, item number, start, covered tokens, slots, exact) of each item found."""
        t, out = Template(column), []
        for width, (keys, item, place, maybe) in self.widths.items():
            h, row, pos = t.windows(width) if width else t.short()
            some = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
            lo = np.searchsorted(keys, h[some], "left")
            n = np.searchsorted(keys, h[some], "right") - lo
            some, lo, n = some[n > 0], lo[n > 0], n[n > 0]
            if not len(some):
                continue
            k = np.repeat(lo, n) + K.expand(n)
            r, p, i, q = np.repeat(row[some], n), np.repeat(pos[some], n), item[k], place[k]
            order = np.lexsort((q, p - q, i, r))
            r, p, i, q = r[order], p[order], i[order], q[order]
            new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | ((p - q)[1:] != (p - q)[:-1])]))
            for s, e in zip(new, np.concatenate([new[1:], [len(r)]])):
                size = int(self.size[i[s]])
                tokens = np.flatnonzero(np.bincount((q[s:e, None] + np.arange(width or size)).ravel()))
                if len(tokens) < min(size, max(COVER * size, 1)) and len(tokens) < LEAST:
                    continue
                there = self.template.first[i[s]] + tokens
                here = t.first[r[s]] + int(p[s] - q[s]) + tokens
                slot = self.template.code[there] <= UNIT
                a, b = self.template.value[there[slot]].tolist(), t.value[here[slot]].tolist()
                if len(set(zip(a, b))) == len(set(a)):
                    out.append((int(r[s]), int(i[s]), int(p[s] - q[s] + tokens[0]), len(tokens), int(slot.sum()), a == b))
        return out


def _slices(benchmark: DataFrame) -> Iterator[Items]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    items = items.withColumn("n", F.length("text") + 64)
    count = -(-(items.agg(F.sum("n")).head()[0] or 0) // SLICE)
    for k in range(count):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in part], [r["text"] for r in part])


def _scan(docs: DataFrame, items: Items) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = []
            for at, piece in K.pieces(batch.column(1)):
                for r, i, start, covered, slots, exact in items.find(piece):
                    size = int(items.size[i])
                    rows.append((ids[at + r], items.ids[i], start, covered, size, covered / size, slots, exact))
            if rows:
                kinds = (*(pa.int64(),) * 5, pa.float64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.mapInArrow(run, SCHEMA)


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, covered, item_tokens, coverage, slots, exact): the items found in documents, each pair once, best alignment."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for items in _slices(benchmark):
        found = found.unionByName(_scan(wanted, items))
    rest = [c.split()[0] for c in SCHEMA.split(", ")[2:]]
    best = F.max_by(F.struct(*rest), F.struct("covered", F.col("exact"), -F.col("start"), "slots"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item; rows without text stay, columns don't change."""
    at = docs.columns.index("text")
    for items in _slices(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, piece in K.pieces(batch.column(at)):
                    for found in items.find(piece):
                        keep[first + found[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
