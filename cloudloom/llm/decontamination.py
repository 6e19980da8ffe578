"""Benchmark decontamination by a prefix-filtered set join.

Each item is cut into windows of ``size`` consecutive words (a shorter item is one window). A window's shingles of
``SHINGLE`` words are ordered by rarity over all documents. Whole containment is asked for, so a document that has the
window has every one of its shingles: the prefix that a join must look up is the single rarest shingle. A match at
word p of a document, for a shingle at offset o of a window of L words, can only be the window at p - o: it must not
begin before the document (positional bound) and must leave L words (length bound). What remains is compared word by word.

Words are numbered by the vocabulary of the windows, with equality of their bytes; a shingle's key holds its words' numbers. So
nothing here is decided by a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .storage import Scratch

WINDOW = 10
SHINGLE = 3
#: Windows (each with one item that has it) and bytes of them in one block: a block is broadcast; more windows make more blocks, each a pass.
PAIRS, BLOCK = 100_000, 16 << 20
#: Words of one window at most, so that the numbers of a block's words fit three times into 63 bits.
LONGEST = 20

NEW = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    T.StructField("hit_spans", T.ArrayType(T.LongType())),
]


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(win, item): the distinct windows of every item, as their words joined by a space, and the item's id as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in X.blocks(batch.column(1)):
                w = X.words(data, offs, X.ALNUM, True)
                words = w.distinct.take(pa.array(w.codes)).to_pylist()
                for item, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True):
                    found = {b" ".join(words[i : min(i + size, b)]).decode() for i in range(a, max(a, b - size) + 1 if b > a else a)}
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string()), pa.array([item] * len(found), pa.string())], names=["win", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    return items.mapInArrow(run, "win string, item string").distinct()


def window_table(pairs: list[tuple[str, str]], size: int) -> dict[str, object]:
    """Distinct windows of (window, item) pairs as numbers of their words (from 1, padded with 0), lengths, the items of each, and the vocabulary."""
    owners: dict[str, list[str]] = {}
    for win, item in pairs:
        owners.setdefault(win, []).append(item)
    vocabulary = X.Vocabulary([w.encode() for win in owners for w in win.split(" ")])
    number = {w.decode(): i + 1 for i, w in enumerate(vocabulary.words.to_pylist())}
    lens = np.array([win.count(" ") + 1 for win in owners], np.int64)
    rows = np.zeros((len(owners), size), np.int64)
    for i, win in enumerate(owners):
        rows[i, : lens[i]] = [number[w] for w in win.split(" ")]
    return {"lens": lens, "rows": rows, "owners": list(owners.values()), "vocabulary": vocabulary, "bits": len(vocabulary.words).bit_length()}


def shingles(table: dict[str, object]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, window, offset) of every shingle of every window."""
    keys, wins, offs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for o in range(table["rows"].shape[1]):
        for k in range(1, SHINGLE + 1):
            # a shorter window is one shingle
            some = np.flatnonzero((table["lens"] >= o + k) & (np.minimum(table["lens"], SHINGLE) == k))
            if not len(some):
                continue
            keys.append(_keys([table["rows"][some, o + j] for j in range(k)], table["bits"]))
            wins.append(some)
            offs.append(np.full(len(some), o))
    return np.concatenate(keys), np.concatenate(wins), np.concatenate(offs)


def _keys(numbers: list[np.ndarray], bits: int) -> np.ndarray:
    out = numbers[0]
    for n in numbers[1:]:
        out = out << bits | n
    return out


def document_shingles(numbers: np.ndarray, ptr: np.ndarray, sizes: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the document shingles, of the sizes that windows have, whose words all have a number, and the words they begin at."""
    keys, begins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = np.repeat(ptr[1:], np.diff(ptr)) - np.arange(len(numbers))  # words from here to the row's end
    run = np.zeros(len(numbers) + 1, np.int64)
    for k in range(1, min(max(sizes, default=0), len(numbers)) + 1):
        run[: len(numbers) - k + 1] += numbers[k - 1 :] > 0
        if k in sizes:
            at = np.flatnonzero((run[:-1] == k) & (left >= k))
            keys.append(_keys([numbers[at + j] for j in range(k)], bits))
            begins.append(at)
    return np.concatenate(keys), np.concatenate(begins)


class Finder:
    """Membership of keys in a sorted table, behind a bit filter that is read first."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.shift = np.uint64(64 - max(16, int(len(table)).bit_length() + 5))
        self.filter = np.zeros(1 << (64 - int(self.shift)), bool)
        self.filter[self._place(table)] = True

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return X.mix(keys.astype(np.uint64)) >> self.shift

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into keys, and into the table, of what is in both."""
        maybe = np.flatnonzero(self.filter[self._place(keys)])
        at = np.searchsorted(self.table, keys[maybe])
        at[at == len(self.table)] = 0
        real = self.table[at] == keys[maybe] if len(self.table) else np.zeros(len(maybe), bool)
        return maybe[real], at[real]


def _counts(docs: DataFrame, table: dict[str, object], keys: np.ndarray, sizes: list[int]) -> np.ndarray:
    """How often each shingle of the sorted keys occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((table["vocabulary"], table["bits"], keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, bits, keys = shared.value
        find, total = Finder(keys), np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, _, data, offs in X.blocks(batch.column(0)):
                w = X.words(data, offs, X.ALNUM, True)
                h, _ = document_shingles(vocabulary.numbers(w), w.ptr, sizes, bits)
                total += np.bincount(find(h)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    found = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(len(keys), np.int64)
    for r in found.toLocalIterator():  # as many rows as the block has shingles, at most
        out[r.at] = r.n
    shared.destroy()
    return out


def _block(docs: DataFrame, pairs: list[tuple[str, str]], size: int) -> dict[str, object]:
    """What a scan for the pairs' windows needs: the windows, and of each the rarest shingle."""
    table = window_table(pairs, size)
    h, win, off = shingles(table)
    sizes = sorted({int(min(n, SHINGLE)) for n in table["lens"]})
    keys = np.unique(h)
    rarity = _counts(docs, table, keys, sizes)[np.searchsorted(keys, h)]
    order = np.lexsort((off, h, rarity, win))
    first = order[np.flatnonzero(np.diff(win[order], prepend=-1))]
    first = first[np.argsort(h[first], kind="stable")]
    tokens, begin = np.unique(h[first], return_index=True)
    return table | {"tokens": tokens, "ptr": np.append(begin, len(first)), "windows": win[first], "offsets": off[first], "sizes": sizes}


Found = tuple[list[list[int]], list[list[str]]]


def _look(w: X.Words, rows: int, b: dict[str, object], find: Finder) -> Found:
    """Of every row, the spans (start, end, ...) of the block's windows that occur, and the items that have these."""
    begins, lens, found = hits(w, b, find)
    row = np.searchsorted(w.ptr, begins, "right") - 1
    spans: list[list[int]] = [[] for _ in range(rows)]
    items: list[set[str]] = [set() for _ in range(rows)]
    for i, s, n, k in zip(row.tolist(), begins.tolist(), lens.tolist(), found.tolist(), strict=True):
        spans[i] += [s - int(w.ptr[i]), s - int(w.ptr[i]) + n]
        items[i].update(b["owners"][k])
    return spans, [sorted(o) for o in items]


def _new(counts: np.ndarray, spans: list[list[int]], items: list[list[str]]) -> list[pa.Array]:
    merged = [union(s) for s in spans]
    n_hit = [sum(s[1::2]) - sum(s[::2]) for s in merged]
    return [
        pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(o) for o in items], pa.int64()), pa.array(items, pa.list_(pa.string())),
        pa.array([hashlib.sha256(",".join(o).encode()).hexdigest() for o in items], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(merged, pa.list_(pa.int64())),
    ]


def _in_one_pass(docs: DataFrame, block: dict[str, object] | None) -> DataFrame:
    """The new columns where one block holds all windows (or there are none)."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    at, names = docs.columns.index("text"), [*docs.columns, *(f.name for f in NEW)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        find = Finder(b["tokens"]) if b else None
        for batch in batches:
            for lo, hi, data, offs in X.blocks(batch.column(at)):
                w = X.words(data, offs, X.ALNUM, True)
                spans, items = _look(w, hi - lo, b, find) if b else ([[]] * (hi - lo), [[]] * (hi - lo))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *_new(np.diff(w.ptr), spans, items)], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *NEW]))


def _block_hits(numbered: DataFrame, block: dict[str, object], s: Scratch) -> DataFrame:
    """(_row, _spans, _items) of the rows that a block's windows hit, written down, so that the block is done with."""
    shared = numbered.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        find = Finder(b["tokens"])
        for batch in batches:
            for lo, hi, data, offs in X.blocks(batch.column(1)):
                spans, items = _look(X.words(data, offs, X.ALNUM, True), hi - lo, b, find)
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["_row", "_spans", "_items"])
                yield out.filter(pa.array([len(x) > 0 for x in spans], pa.bool_()))

    out = s.settle(numbered.select("_row", "text").mapInArrow(run, "_row long, _spans array<long>, _items array<string>"), "hits")
    shared.destroy()
    return out


def _merge(numbered: DataFrame, parts: DataFrame) -> DataFrame:
    """The new columns from the hits of all blocks. A row's hits are as many as it has windows, and rows are spread by their number."""
    united = parts.groupBy("_row").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
    both = numbered.join(united, "_row", "left")
    kept = [f for f in numbered.schema.fields if f.name != "_row"]
    both = both.select(*(f.name for f in kept), "_spans", "_items")
    at, names = [f.name for f in kept].index("text"), [*(f.name for f in kept), *(f.name for f in NEW)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in X.blocks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                counts = np.diff(X.words(data, offs, X.ALNUM, True).ptr)
                spans, items = ([x or [] for x in part.column(len(kept) + i).to_pylist()] for i in range(2))
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *_new(counts, spans, items)], names=names)

    return both.mapInArrow(run, T.StructType([*kept, *NEW]))


def union(spans: list[int]) -> list[int]:
    """Start, end, start, end, ... of the united spans, in order."""
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def hits(w: X.Words, b: dict[str, object], find: Finder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin word, length and number of every window that occurs."""
    numbers = b["vocabulary"].numbers(w)
    h, begin = document_shingles(numbers, w.ptr, b["sizes"], b["bits"])
    mine, token = find(h)
    n = b["ptr"][token + 1] - b["ptr"][token]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    each = np.repeat(b["ptr"][token], n) + within
    win = b["windows"][each]
    start, length = np.repeat(begin[mine], n) - b["offsets"][each], b["lens"][win]
    row = np.searchsorted(w.ptr, np.repeat(begin[mine], n), "right") - 1
    fits = (start >= w.ptr[row]) & (start + length <= w.ptr[row + 1])
    start, win, length = start[fits], win[fits], length[fits]
    same = np.ones(len(start), bool)
    for j in range(b["rows"].shape[1]):
        at = np.flatnonzero(same & (length > j))
        same[at] = numbers[start[at] + j] == b["rows"][win[at], j]
    return start[same], length[same], win[same]


def mark(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Adds to each document what it shares with the benchmark.

    New columns: n_words, n_hit (words inside an occurring window), n_items, items (ids as strings, sorted), items_sha256,
    contaminated (n_hit > 0) and hit_spans (start, end, start, end, ... in words). Input columns of these names are
    replaced. Null and empty texts have no words; long texts are read whole. Items with a null id or text are left out; equal ids count
    once. With no items nothing is hit. Repeated documents are judged row by row. No shuffle of documents is made where one block holds
    the benchmark's windows; otherwise each block is a scan of its own whose hits are written, and these are joined once.
    """
    if not 1 <= size <= LONGEST:
        raise ValueError(f"a window has 1 to {LONGEST} words")
    s = Scratch(docs.sparkSession)
    docs = docs.drop(*(f.name for f in NEW), "_spans", "_items", "_row")
    pairs = s.settle(item_windows(benchmark, size), "windows")
    r = pairs.agg(F.count("*").alias("n"), F.sum(F.octet_length("win") + F.octet_length("item")).alias("bytes")).first()
    blocks = max(-(-r.n // PAIRS), -(-(r.bytes or 0) // BLOCK))
    part = lambda k: [(x.win, x.item) for x in pairs.where(F.pmod(F.xxhash64("win", "item"), F.lit(blocks)) == k).collect()]
    if blocks <= 1:
        out = _in_one_pass(docs, _block(docs, part(0), size) if blocks else None)
    else:
        numbered = s.settle(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")  # fixed by writing it
        found = [_block_hits(numbered, _block(numbered, some, size), s) for k in range(blocks) if (some := part(k))]
        out = _merge(numbered, s.settle(s.union(found), "all-hits"))
        s.drop(*found)
    s.drop(pairs)
    return out
