"""Removal of passages that occurred before, by suffix automata of reference shards.

A window is SPAN consecutive words of one document; a word goes if a window covers it that also begins earlier in the corpus.

1. Of the rows with one word sequence (by 160 bits of BLAKE2b over the words) the first and, for all others, the second are looked at;
   what goes from the second goes from its copies.
2. Candidates: of the 6-word shingles in every window the one with the smallest hash is its anchor, so equal windows have equal
   anchors. Windows whose anchor occurs once in the corpus are unique; only the others are looked at further.
3. The first place of every candidate window (by 96 bits of hash, with map-side minima) tells where its reference is. Reference shards are
   stretches of SHARD window starts in a document, as far as they are the first place of something.
4. Each shard's words become a suffix automaton. The runs of repeated windows that point to the shard are streamed through it for
   matching statistics; where at least SPAN words match that begin earlier, the maximal spans are removed. This compares words, not
   hashes. A second copy's runs point to the shards of the first, place by place.

The reference grows with the corpus, and so a shard's automaton is not sent to every executor: shards and runs meet by a join on the
shard, in which Spark splits frequent shards. An automaton holds SHARD + SPAN - 1 words at most.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .storage import Scratch, anti_join, split, spread_join

SPAN = 20
ANCHOR = 6
SHARD = 256


class SuffixAutomaton:
    """The suffix automaton of a sequence of words; ``first`` is where a state's strings first end."""

    def __init__(self, words: list[bytes]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for i, w in enumerate(words):
            new = self._state({}, 0, i + 1, i)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    copy = self._state(self.next[q].copy(), self.link[q], self.length[p] + 1, self.first[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = copy
                        p = self.link[p]
                    self.link[q] = self.link[new] = copy
            last = new

    def _state(self, arcs: dict[bytes, int], link: int, length: int, first: int) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def matches(self, words: list[bytes], span: int) -> Iterator[tuple[int, int]]:
        """(end, first end in the reference) of every ``span`` words of the stream that occur in the reference."""
        arcs, link, length = self.next, self.link, self.length
        v = matched = 0
        for i, w in enumerate(words):
            while v and w not in arcs[v]:
                v = link[v]
                matched = length[v]
            if w in arcs[v]:
                v = arcs[v][w]
                matched += 1
            if matched >= span:
                s = v
                while length[link[s]] >= span:
                    s = link[s]
                yield i, self.first[s]


def minimisers(w: X.Words, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window begins (as words of the block), their anchors' words and hashes, and row pointers into these."""
    k = min(ANCHOR, span)
    g, at, gptr = X.grams(w.hashes, w.ptr, k)
    wide = span - k + 1
    counts = np.maximum(np.diff(w.ptr) - span + 1, 0)
    wptr = np.concatenate([[0], np.cumsum(counts)])
    begin = np.arange(wptr[-1]) + np.repeat(gptr[:-1] - wptr[:-1], counts)
    best = np.empty(len(begin), np.int64)
    if len(begin):
        view = np.lib.stride_tricks.sliding_window_view(g, wide)
        for i in range(0, len(begin), 1 << 16):
            part = begin[i : i + (1 << 16)]
            best[i : i + (1 << 16)] = part + view[part].argmin(axis=1)
    return at[begin] if len(begin) else begin, at[best] if len(begin) else begin, g[best] if len(begin) else np.zeros(0, np.uint64), wptr


def marks(docs: DataFrame, span: int) -> DataFrame:
    """doc_id, fingerprint of the word sequence, and the anchors and their words, of every row with a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in X.blocks(batch.column(1)):
                w = X.words(data, offs, X.SPACE)
                _, word, anchor, wptr = minimisers(w, span)
                # an anchor serves several windows in a row, and then no more
                fresh = np.ones(len(word), bool)
                fresh[1:] = word[1:] != word[:-1]
                fresh[wptr[:-1][wptr[:-1] < len(word)]] = True
                row = np.repeat(np.arange(hi - lo), np.diff(wptr))[fresh]
                ptr = np.searchsorted(row, np.arange(hi - lo + 1))
                texts = batch.column(1).slice(lo, hi - lo)
                prints = [hashlib.blake2b(b" ".join(_word_list(t.as_py())), digest_size=20).digest() for t in texts]
                anchors, words = X.lists(X.as_long(anchor[fresh]), ptr, pa.int64()), X.lists((word[fresh] - w.ptr[row]).astype(np.int32), ptr, pa.int32())
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(prints, pa.binary()), anchors, words], names=["doc_id", "print", "anchors", "words"])
                yield out.filter(pa.array(np.diff(wptr) > 0))

    return docs.mapInArrow(run, "doc_id long, print binary, anchors array<long>, words array<int>")


def candidates(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """Per document, the windows whose anchor is one of ``at``: 96 bits of hash (h, g) and begin (p; -1 - p where the document has it earlier)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in X.blocks(batch.column(1)):
                w = X.words(data, offs, X.SPACE)
                begin, word, _, wptr = minimisers(w, span)
                at = batch.column(2).slice(lo, hi - lo)
                repeated = np.zeros(len(w.starts) + 1, bool)
                sizes = at.value_lengths().to_numpy(zero_copy_only=False)
                repeated[at.flatten().to_numpy() + np.repeat(w.ptr[:-1], sizes)] = True
                use = np.flatnonzero(repeated[word])
                h, g = (X.grams(x, w.ptr, span)[0][use] for x in (w.hashes, w.seconds))
                row = np.repeat(np.arange(hi - lo), np.diff(wptr))[use]
                begin = begin[use] - w.ptr[row]
                # the first place within the document
                order = np.lexsort((begin, g, h, row))
                again = np.zeros(len(order), bool)
                again[1:] = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1]) & (row[order][1:] == row[order][:-1])
                begin[order[again]] = -1 - begin[order[again]]
                ptr = np.searchsorted(row, np.arange(hi - lo + 1))
                made = [X.lists(X.as_long(h), ptr, pa.int64()), X.lists((g >> X.U64(32)).astype(np.uint32).view(np.int32), ptr, pa.int32()), X.lists(begin.astype(np.int32), ptr, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *made], names=["doc_id", "h", "g", "p"])

    near = split(docs, wanted, "doc_id")[0].join(wanted, "doc_id").select("doc_id", "text", "at")
    return near.mapInArrow(run, "doc_id long, h array<long>, g array<int>, p array<int>")


def _word_list(text: str | None) -> list[bytes]:
    """Words of a text; bytes.split() divides at the same six characters."""
    return (text or "").encode().split()


def runs(docs: DataFrame, repeats: DataFrame, span: int) -> DataFrame:
    """(ref, shard, doc_id, lo, words): maximal runs of repeated windows of a document that point to one shard.

    repeats: (doc_id, found, whole); whole is the document that this one is a copy of, if it is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words = _word_list(batch.column(1)[i].as_py())
                if (first := batch.column(3)[i].as_py()) is not None:
                    p = at = np.arange(len(words) - span + 1)
                    ref = np.full(len(p), first)
                else:
                    found = batch.column(2)[i].values
                    p, ref, at = (found.field(c).to_numpy() for c in ("p", "ref", "at"))
                order = np.argsort(p, kind="stable")
                p, ref, shard = p[order], ref[order], at[order] // SHARD
                cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(ref) != 0) | (np.diff(shard) != 0)) + 1
                first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(p)]]) - 1
                texts = [b" ".join(words[p[a] : p[b] + span]) for a, b in zip(first, last, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ref[first]), pa.array(shard[first].astype(np.int32)), pa.array(np.full(len(first), batch.column(0)[i].as_py()), pa.int64()), pa.array(p[first].astype(np.int32)), pa.array(texts, pa.binary())],
                    names=["ref", "shard", "doc_id", "lo", "words"],
                )

    near = split(docs, repeats, "doc_id")[0].join(repeats, "doc_id").select("doc_id", "text", "found", "whole")
    return near.mapInArrow(run, "ref long, shard int, doc_id long, lo int, words binary")


def shards(docs: DataFrame, asked: DataFrame, span: int) -> DataFrame:
    """(ref, shard, reference): the words of the asked shards (doc_id, shards, all: whether all are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, numbers, whole in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                words = _word_list(text)
                numbers = list(range(-(-(len(words) - span + 1) // SHARD))) if whole else numbers
                texts = [b" ".join(words[n * SHARD : (n + 1) * SHARD + span - 1]) for n in numbers]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(numbers), pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.binary())], names=["ref", "shard", "reference"])

    near = split(docs, asked, "doc_id")[0].join(asked, "doc_id").select("doc_id", "text", "shards", "all")
    return near.mapInArrow(run, "ref long, shard int, reference binary")


@functools.lru_cache(64)
def automaton(reference: bytes) -> SuffixAutomaton:
    """The automaton of a shard; a worker keeps the last ones, as the runs of a shard need not follow one another."""
    return SuffixAutomaton(reference.split())


def spans(met: DataFrame, span: int) -> DataFrame:
    """(doc_id, lo, hi): what matching statistics against the shard's automaton confirm, as maximal spans of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for ref, shard, doc, lo, words, reference in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                begin = end = -1
                for i, first in automaton(reference).matches(words.split(), span):
                    if ref == doc and shard * SHARD + first >= lo + i:
                        continue  # the document's own place, not an earlier one
                    if i - span + 1 > end:
                        if end > begin:
                            rows.append((doc, lo + begin, lo + end))
                        begin = i - span + 1
                    end = i + 1
                if end > begin:
                    rows.append((doc, lo + begin, lo + end))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=["doc_id", "lo", "hi"])

    return met.select("ref", "shard", "doc_id", "lo", "words", "reference").mapInArrow(run, "doc_id long, lo int, hi int")


NEW = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType())), T.StructField("kept_text", T.StringType())]


def _strip(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Applies ``_spans`` (lo, hi, lo, hi, ...) to each row."""
    fields = [f for f in docs.schema.fields if f.name in columns]
    docs = docs.select(*columns, "_spans")
    at, names = columns.index("text"), [*columns, *(f.name for f in NEW)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in X.blocks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                total, gone, where, kept = [], [], [], []
                for text, found in zip(part.column(at).to_pylist(), part.column(len(columns)).to_pylist(), strict=True):
                    words = _word_list(text)
                    cut: list[int] = []
                    for a, b in sorted(zip(found[::2], found[1::2], strict=True)) if found else ():
                        if cut and a <= cut[-1]:
                            cut[-1] = max(cut[-1], b)
                        else:
                            cut += [a, b]
                    total.append(len(words))
                    gone.append(sum(cut[1::2]) - sum(cut[::2]))
                    where.append(cut)
                    for a, b in zip(cut[-2::-2], cut[::-2], strict=True):
                        del words[a:b]
                    kept.append(b" ".join(words).decode())
                made = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(where, pa.list_(pa.int32())), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=names)

    return docs.mapInArrow(run, T.StructType([*fields, *NEW]))


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Adds n_words, n_removed, removed (lo, hi, lo, hi, ... in words) and kept_text (kept words joined by one space).

    "Earlier" is a smaller doc_id, or the same and an earlier begin; windows are judged on the input. Null and empty texts
    have no words. Texts shorter than a window lose nothing; long texts are read whole. Rows with one doc_id and one text are one document:
    its windows are not earlier than themselves, and all its rows lose the same. Of rows with one doc_id and different texts those with the
    smallest 64-bit hash of the text are the document; the others are neither compared nor changed, nor are rows with a null doc_id.
    Other columns are kept; input columns with the new names are replaced. An empty table gives an empty one.
    """
    s = Scratch(docs.sparkSession)
    docs = docs.drop(*(f.name for f in NEW), "_spans", "_one")
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    ids = texts.groupBy("doc_id").agg(*(f(F.xxhash64("text")).alias(f.__name__) for f in (F.min, F.max))).where("min < max").select("doc_id", F.col("min").alias("_one"))
    ids = s.settle(ids, "ids")
    if several := not ids.isEmpty():
        some, others = split(texts, ids, "doc_id")
        texts = others.unionByName(some.join(ids, "doc_id", "left").where("_one is null or _one = xxhash64(text)").drop("_one"))
    marked = s.settle(marks(texts, span), "marks")
    n = marked.count()
    prints = s.settle(marked.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last"), "prints", n)
    # one row per copy: the document it repeats, and the second of the group, which stands for all but the first
    copies = s.settle(spread_join(marked.select("print", "doc_id"), prints.drop("last"), "print", "n", n).where("doc_id > first"), "all-copies", n)
    seconds = copies.groupBy("print").agg(F.min("doc_id").alias("second"), F.count("*").alias("n"))
    old, copies = copies, s.settle(spread_join(copies, s.settle(seconds, "seconds", n), "print", "n", n).groupBy("doc_id").agg(F.min("first").alias("first"), F.min("second").alias("second")), "copies", n)
    s.drop(prints, old)
    single = anti_join(marked, copies, "doc_id")
    anchors = single.select("doc_id", F.explode(F.arrays_zip("anchors", "words")).alias("a")).select("doc_id", F.col("a.anchors").alias("anchor"), F.col("a.words").alias("word"))
    repeated = s.settle(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    s.drop()
    total = repeated.agg(F.sum("n")).first()[0] or 0
    again = spread_join(split(anchors, repeated.select("anchor"), "anchor")[0], repeated, "anchor", "n", total)
    wanted = s.settle(again.groupBy("doc_id").agg(F.collect_list("word").alias("at")), "wanted", n, 10_000)
    s.drop(marked, repeated)
    windows = s.settle(candidates(texts, wanted, span), "windows")
    s.drop(wanted)
    each = windows.select("doc_id", F.explode(F.arrays_zip("h", "g", "p")).alias("w")).select("doc_id", F.col("w.h").alias("h"), F.col("w.g").alias("g"), F.col("w.p").alias("p"))
    place = F.when(F.col("p") >= 0, F.col("p"))
    origin = each.groupBy("h", "g").agg(F.min("doc_id").alias("ref"), F.min_by(place, F.when(place.isNotNull(), F.col("doc_id"))).alias("at"), F.count("*").alias("n")).where("n > 1")
    origin = s.settle(origin, "origin")
    total = origin.agg(F.sum("n")).first()[0] or 0
    later = spread_join(each, origin, ["h", "g"], "n", total).withColumn("p", F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p")))
    later = s.settle(later.where("doc_id > ref or doc_id = ref and p > at").select("doc_id", "p", "ref", "at"), "later")
    s.drop(windows, origin)
    # of a group of copies the second's windows point to the first's
    whole = copies.where("doc_id = second").select("doc_id", F.col("first").alias("whole"))
    repeats = later.groupBy("doc_id").agg(F.collect_list(F.struct("p", "ref", "at")).alias("found")).join(whole, "doc_id", "full")
    asked = later.select("ref", F.floor(F.col("at") / SHARD).cast("int").alias("shard")).distinct()
    asked = asked.groupBy(F.col("ref").alias("doc_id")).agg(F.collect_list("shard").alias("shards"))
    # all shards of a document that has copies
    firsts = whole.select(F.col("whole").alias("doc_id")).distinct().withColumn("all", F.lit(True))
    asked = asked.join(firsts, "doc_id", "full")
    repeats, asked = s.settle(repeats, "repeats", n, 5000), s.settle(asked, "asked", n, 20_000)
    s.drop(later)
    streams, references = s.settle(runs(texts, repeats, span), "runs"), s.settle(shards(texts, asked, span), "shards")
    s.drop(repeats, asked)
    asks = s.settle(streams.groupBy("ref", "shard").agg(F.count("*").alias("n")), "asks")
    total = asks.agg(F.sum("n")).first()[0] or 0
    references = references.join(asks, ["ref", "shard"])
    found = s.settle(spans(spread_join(streams, references, ["ref", "shard"], "n", total), span), "found")
    s.drop(asks, streams)
    found = found.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("lo", "hi"))).alias("_spans"))
    # what goes from the second copy goes from the others
    own = s.settle(found, "own", n, 20_000)
    others = copies.where("doc_id > second").select("doc_id", F.col("second"))
    seconds = own.join(others.groupBy("second").agg(F.count("*").alias("n")).withColumnRenamed("second", "doc_id"), "doc_id").withColumnRenamed("doc_id", "second")
    seconds = s.settle(seconds, "second-spans", n, 20_000)
    theirs = spread_join(others, seconds, "second", "n", n).select("doc_id", "_spans")
    found = s.settle(own.unionByName(theirs), "spans", n, 20_000)
    s.drop(own, seconds, copies)
    touched, untouched = split(docs, found, "doc_id")
    touched = touched.join(found, "doc_id", "left")
    if several:
        touched = touched.join(ids, "doc_id", "left").withColumn("_spans", F.when(F.expr("_one is null or _one = xxhash64(text)"), F.col("_spans")))
    touched = touched.select(*docs.columns, "_spans")
    return _strip(touched.unionByName(untouched.withColumn("_spans", F.lit(None).cast("array<int>"))), docs.columns)
