"""Near-duplicate groups by banded MinHash, odd sketches and an exact check.

1. Every document becomes a set of 5-word shingles, MinHash samples of it, band keys of six samples each (168 and 28 for a
   threshold of 0.85, 264 and 44 for 0.8), and an odd sketch: the samples are folded into a parity bitmap of 512 bits. Documents with equal sets are one class from here on.
2. In every bucket (equal band key) one member, drawn by a hash that differs from bucket to bucket, is the centre; the others
   are paired with it. The number of pairs is linear in the memberships, whatever the size of a bucket.
3. The population count of two sketches' XOR estimates their similarity; pairs that are far below the threshold go. So do pairs that a
   second, finer parity bitmap, of the whole set, shows to be below it.
4. The best pair of every class is verified on full sets and the links are joined to components; then the other pairs whose ends
   are still apart are.
5. In buckets that still hold several components, members of different components are compared with one another in blocks
   of bounded size (never inside one component, nor inside the largest), by the sketches and then exactly: first the
   nearest of each, then all that are still apart. After that every two classes
   that share a bucket are in one component or have been found unlinked.

At the threshold two sets share no bucket with a probability below 2e-6, (1 - 0.85^6)^28 or (1 - 0.8^6)^44, and less above.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .components import components
from .storage import Scratch, anti_join, semi_join, settle, spread_join

SHINGLE = 5
BANDS, ROWS = 28, 6
#: The chance that a pair at the threshold shares no bucket is below this; BANDS suit PERCENT.
MISSED = 2e-6
SKETCH = 512
#: Bits of the fine sketch, which folds the set itself.
FINE = 2048
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: An estimate this many standard deviations below the threshold is not verified.
SIGMAS = 5
#: Classes of one block when members of a bucket are compared with one another.
SIDE = 256


@functools.cache
def _draws(bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Factors and summands of the samples, multipliers of the bands, and salts of the cells."""
    rng, n = np.random.Generator(np.random.PCG64(77)), bands * ROWS
    a = (rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1))[:, None]
    b = rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]
    band = rng.integers(0, 2**64, (bands, ROWS), dtype=np.uint64) | np.uint64(1)
    return a, b, band, rng.integers(0, 2**64, n, dtype=np.uint64)


def bands_for(percent: int) -> int:
    """The fewest bands with which a pair at the threshold is missed with a chance below MISSED."""
    return math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS))) if percent < 100 else 1


def shingle_sets(hashes: np.ndarray, w: X.Words) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row, from its words' hashes; of a row with fewer words, the hash of all of them."""
    g, _, ptr = X.grams(hashes, w.ptr, SHINGLE)
    for i in range(len(w.ptr) - 1):
        if ptr[i + 1] > ptr[i]:
            yield np.unique(g[ptr[i] : ptr[i + 1]])
        else:
            n = int(w.ptr[i + 1] - w.ptr[i])
            yield X.grams(hashes[w.ptr[i] : w.ptr[i + 1]], np.array([0, n]), n)[0] if n else np.zeros(0, np.uint64)


def samples(s: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """MinHash samples of a set that isn't empty."""
    a, b, _, _ = _draws(bands)
    x = (s >> np.uint64(32)).astype(np.uint32)
    parts = [(x[i : i + 4096] * a + b).min(axis=1) for i in range(0, len(x), 4096)]
    return parts[0] if len(parts) == 1 else np.min(parts, axis=0)


def band_keys(m: np.ndarray) -> np.ndarray:
    """Keys (rows, bands) of samples (rows, bands * ROWS); they hold the band's number."""
    bands = m.shape[1] // ROWS
    band = _draws(bands)[2]
    v = X.mix(m.reshape(-1, bands, ROWS).astype(np.uint64) + band)
    return X.mix((v * band).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows, SKETCH / 64) of samples (rows, bands * ROWS)."""
    cell = (X.mix(m.astype(np.uint64) ^ _draws(m.shape[1] // ROWS)[3]) % np.uint64(SKETCH)).astype(np.int64)
    return _parities((cell + np.arange(len(m))[:, None] * SKETCH).ravel(), len(m), SKETCH)


def _parities(cells: np.ndarray, rows: int, bits: int) -> np.ndarray:
    flat = np.bincount(cells, minlength=rows * bits)
    return np.packbits((flat & 1).astype(bool).reshape(rows, bits), axis=1).view(np.int64)


def fine_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps (rows, FINE / 64) of whole sets."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cell = (np.concatenate(sets) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - FINE.bit_length() + 1)
    return _parities(cell.astype(np.int64) + row * FINE, len(sets), FINE)


def odd_cells(thrown: np.ndarray | float, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the number of cells that get an odd number of ``thrown`` balls."""
    one, two = (1 - 2 / cells) ** thrown, (1 - 4 / cells) ** thrown
    mean = cells / 2 * (1 - one)
    return mean, np.maximum(mean + cells * (cells - 1) / 4 * (1 - 2 * one + two) - mean * mean, 0)


def most_ones(percent: int = PERCENT) -> int:
    """The most ones in an XOR of sketches with which a pair may still reach the threshold.

    Of n samples a pair at similarity J differs in n * (1 - J) on either side; so many cells are odd, less those that meet
    in one. The margin is SIGMAS standard deviations of both together, the samples' and the cells'.
    """
    j, n = percent / 100, bands_for(percent) * ROWS
    apart, spread = 2 * n * (1 - j), 2 * math.sqrt(n * j * (1 - j))
    at, by_cells = odd_cells(apart, SKETCH)
    by_samples = (odd_cells(apart + SIGMAS * spread, SKETCH)[0] - at) / SIGMAS
    return math.ceil(at + SIGMAS * math.hypot(by_samples, math.sqrt(by_cells)))


def most_fine_ones(sizes, percent: int = PERCENT, of=np):
    """The same for fine sketches, which fold the sets themselves; sizes: of both sets together, an array (or, of F, a column).

    At the threshold two sets differ in (1 - J) / (1 + J) of their sizes' sum. There is no sampling error; where a sketch is too small for
    its sets, the limit rises to what any pair reaches, and nothing is dropped.
    """
    apart = sizes * ((100 - percent) / (100 + percent))
    lit = F.lit if of is F else float
    one, two = of.pow(lit(1 - 2 / FINE), apart), of.pow(lit(1 - 4 / FINE), apart)
    at = FINE / 2 * (1 - one)
    by_cells = at + FINE * (FINE - 1) / 4 * (1 - 2 * one + two) - at * at
    return of.ceil(at + SIGMAS * of.sqrt(of.abs(by_cells)) + 1)


def profile(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), odd sketch, fine sketch and band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in X.blocks(batch.column(1)):
                w = X.words(data, offs, X.SPACE, True)
                sets = list(shingle_sets(w.hashes, w))
                # classes are told apart by both halves of the hashes
                prints = [hashlib.blake2b(a.tobytes() + b.tobytes(), digest_size=16).digest() if len(a) else None for a, b in zip(sets, shingle_sets(w.seconds, w), strict=True)]
                full = np.array([len(s) > 0 for s in sets])
                m = np.zeros((len(sets), bands * ROWS), np.uint32)
                for i in np.flatnonzero(full).tolist():
                    m[i] = samples(sets[i], bands)
                listed = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(a).ravel()), a.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prints, pa.binary()),
                        listed(odd_sketches(m)),
                        listed(fine_sketches(sets)),
                        listed(X.as_long(band_keys(m))),
                    ],
                    names=["doc_id", "n_shingles", "digest", "sketch", "fine", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch array<long>, fine array<long>, bands array<long>")


def ones(a: Column, b: Column, bits: int) -> Column:
    """Population count of the XOR of two sketches."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(bits // 64)), F.lit(0))


def _near(pairs: DataFrame, classes: DataFrame, sketch: str, bits: int, limit: Column, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the threshold, and their number of odd cells."""
    own = classes.select("node", "n_shingles", sketch)
    ends = [own.select(F.col("node").alias(e), F.col("n_shingles").alias(f"n{e}"), F.col(sketch).alias(f"s{e}")) for e in "ab"]
    joined = pairs.select("a", "b").join(ends[0], "a").join(ends[1], "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return joined.withColumn("ones", ones(F.col("sa"), F.col("sb"), bits)).where(F.col("ones") <= limit).select("a", "b", "ones")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The lower-cased words of the given class representatives, joined by a space."""
    lower = bytes(X.LOWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [b" ".join((t or "").encode().translate(lower).split()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], names=["node", "words"])

    wanted = semi_join(docs.select("doc_id", "text"), nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id")
    return wanted.mapInArrow(run, "node long, words binary")


def exact_shingles(w: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of every shingle of a block; numbers are equal where the words are. Fewer words are filled up by a mark."""
    size = np.diff(w.ptr)
    counts = np.where(size > 0, np.maximum(size - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(len(size)), counts)
    at = np.arange(len(row)) + np.repeat(w.ptr[:-1] - (np.cumsum(counts) - counts), counts)
    key, most, mark = np.zeros(len(row), np.int64), 1, len(w.distinct)
    for j in range(SHINGLE):
        code = np.where(at + j < w.ptr[row + 1], w.codes[np.minimum(at + j, max(len(w.codes) - 1, 0))], mark) if len(row) else key
        if most * (mark + 1) > 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            most = int(key.max(initial=0)) + 1
        key, most = key * (mark + 1) + code, most * (mark + 1)
    return row, np.unique(key, return_inverse=True)[1]


def reaches(x: pa.Array, y: pa.Array, percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, of the word shingles of each two texts: by the words themselves."""
    n = len(x)
    text = pa.concat_arrays([x, y]).cast(pa.string())
    row, shingle = exact_shingles(X.words(*X.raw(text), X.SPACE))
    top = int(shingle.max(initial=0)) + 1
    keys = [np.unique((row[m] - lo) * top + shingle[m]) for m, lo in ((row < n, 0), (row >= n, n))]
    sizes = sum(np.bincount(k // top, minlength=n) for k in keys)
    common = np.bincount(np.intersect1d(*keys, assume_unique=True) // top, minlength=n)
    return 100 * common >= percent * (sizes - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.concatenate([[0], np.cumsum([len(x.as_buffer()) + len(y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3), strict=True)])])
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(size, size[lo] + X.BLOCK_BYTES, "right")) - 1)
                part = batch.slice(lo, hi - lo)
                keep = reaches(part.column(2), part.column(3), percent)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
                lo = hi

    at_a, at_b = sets.select(F.col("node").alias("a"), F.col("words").alias("x")), sets.select(F.col("node").alias("b"), F.col("words").alias("y"))
    return pairs.select("a", "b").join(at_a, "a").join(at_b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    at_a, at_b = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    joined = pairs.join(at_a, "a", "left").join(at_b, "b", "left")
    return joined.where("coalesce(ca, a) <> coalesce(cb, b)").drop("ca", "cb")


def _rest(buckets: DataFrame, labels: DataFrame, classes: DataFrame, percent: int, best: bool, m: int, s: Scratch) -> DataFrame:
    """Candidate pairs (a, b) of different components in one bucket, of which neither end is the bucket's centre.

    best: of every block only the nearest of each node. m: rows of ``buckets``.
    """
    limit = most_ones(percent)
    at = labels.select(F.col("node").alias("node"), "component")
    here = buckets.where("size > 2 and node <> centre").join(at, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    counts = here.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    # the largest component of a bucket (role 0) is not compared with itself; block counts by role
    counts = counts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n0"), F.sum("n").alias("n1")).where("n0 < n1")
    side = F.lit(SIDE)
    counts = counts.select("bucket", "main", F.ceil(F.col("n0") / side).cast("int").alias("b0"), F.ceil((F.col("n1") - F.col("n0")) / side).cast("int").alias("b1"), "n1")
    counts = s.settle(counts, "mixed")
    here = spread_join(here, counts, "bucket", "n1", m).join(classes.select("node", "n_shingles", "sketch", "fine"), "node")
    main = F.col("component") == F.col("main")
    block = F.pmod(F.xxhash64("node"), F.when(main, F.col("b0")).otherwise(F.col("b1"))).cast("int")
    here = here.withColumn("role", F.when(main, 0).otherwise(1)).withColumn("block", block)
    key = lambda role, i, j: F.struct(F.lit(role).alias("with"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    others = F.sequence(F.lit(0), F.col("b1") - 1)
    mains = F.sequence(F.lit(0), F.col("b0") - 1)
    keys = F.when(main, F.transform(others, lambda j: key(0, F.col("block"), j))).otherwise(
        F.concat(F.transform(mains, lambda i: key(0, i, F.col("block"))), F.transform(others, lambda j: key(1, F.least(j, F.col("block")), F.greatest(j, F.col("block")))))
    )
    dealt = here.select("bucket", F.explode(keys).alias("k"), "node", "component", "n_shingles", "sketch", "fine")

    def compare(table: pa.Table) -> pa.Table:
        node, comp, n = (table[c].to_numpy() for c in ("node", "component", "n_shingles"))
        bits, fine = (table[c].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1) for c in ("sketch", "fine"))
        few, many = np.minimum.outer(n, n), np.maximum.outer(n, n)
        i, j = np.nonzero(np.triu(np.not_equal.outer(comp, comp) & (100 * few >= percent * many), 1))
        near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= limit
        i, j = i[near], j[near]
        odd = np.bitwise_count(fine[i] ^ fine[j]).sum(axis=1, dtype=np.int64)
        near = odd <= most_fine_ones(n[i] + n[j], percent)
        i, j, odd = i[near], j[near], odd[near]
        if best:
            order = np.lexsort((odd, i))
            order = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
            i, j = i[order], j[order]
        return pa.table({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})

    return dealt.groupBy("bucket", "k").applyInArrow(compare, "a long, b long").distinct()


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that can be reached over links, the document's own included; kept is doc_id =
    component_id. Null and empty texts, and texts without words, have no shingles and are linked with nothing. Rows that share a
    doc_id are one document for the components. Rows with a null doc_id take part in nothing: their component_id is
    null and they are kept. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    s = Scratch(spark)
    bands = bands_for(percent)
    profiles = s.settle(profile(docs, bands), "profiles")
    real = profiles.where("digest is not null and doc_id is not null")
    # one row per distinct set; what else the rows of equal sets have is equal
    classes = real.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n_shingles", "sketch", "fine", "bands")))
    n = profiles.count()
    classes = s.settle(classes, "classes", n, 20_000)
    members = classes.select("node", F.explode("bands").alias("bucket"))
    centres = members.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", "bucket")).alias("centre"), F.count("*").alias("size")).where("size > 1")
    centres = s.settle(centres, "centres", bands * n)
    m = centres.agg(F.sum("size")).first()[0] or 0
    buckets = s.settle(spread_join(members, centres.withColumn("rows", F.col("size")), "bucket", "rows", m), "buckets", bands * n)
    s.drop(centres)
    pairs = buckets.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = s.settle(_near(pairs, classes, "sketch", SKETCH, F.lit(most_ones(percent)), percent), "pairs", m, 40_000)
    pairs, old = s.settle(_near(pairs, classes, "fine", FINE, most_fine_ones(F.col("na") + F.col("nb"), percent, F), percent), "pairs", m, 20_000), pairs
    s.drop(old)
    sets = s.settle(_sets(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b"))), "sets", min(n, 2 * pairs.count()), 5000)
    links = s.settle(_verified(pairs.groupBy("a").agg(F.min_by("b", F.struct("ones", "b")).alias("b")), sets, percent), "links", n, 4000)
    labels, used = components(links, s), [buckets, pairs, sets, links]

    def more(candidates: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
        """The labels after the candidates' links."""
        new = s.settle(_verified(candidates, sets, percent), "links", m, 8000)
        used.append(new)
        if new.isEmpty():
            return labels
        # only what is joined anew is worked on: components of components
        at_a, at_b = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        ends = new.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        over = components(ends, s)
        joined = labels.join(over.select(F.col("node").alias("component"), F.col("component").alias("over")), "component", "left")
        fresh = over.join(labels.select("node"), "node", "left_anti")
        out = s.settle(joined.select("node", F.coalesce("over", "component").alias("component")).union(fresh), "labels", n)
        s.drop(over, labels)
        return out

    labels = more(_apart(pairs, labels), sets, labels)
    for best in (True, False):
        rest = s.settle(_rest(buckets, labels, classes, percent, best, m, s), "rest", m)
        used.append(rest)
        if rest.isEmpty():
            break
        ends = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct().join(sets.select("node"), "node", "left_anti")
        others = s.settle(_sets(docs, ends), "sets", min(n, 2 * rest.count()), 5000)
        used.append(others)
        sets = sets.union(others)
        labels = more(rest, sets, labels)
    s.drop(*used)
    named = classes.select("digest", F.col("node").alias("class_id"), "copies").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    named = s.settle(named.select("digest", F.coalesce("component", "class_id").alias("component"), "copies"), "named", n)
    out = spread_join(profiles.select("doc_id", "n_shingles", "digest"), named, "digest", "copies", n, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without near copies: one of each group stays, that with the smallest doc_id (the rows of one doc_id alike)."""
    gone = settle(groups(docs, percent).where("not kept").select("doc_id").distinct(), "gone")
    return anti_join(docs, gone, "doc_id")
