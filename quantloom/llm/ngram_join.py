"""N-gram Jaccard join: all links between texts whose word n-gram sets are similar, and their components.

Exact set-similarity join in size-banded tiles:

1. every text becomes the sorted array of its distinct n-gram hashes; equal sets are one *class* from here on. One
   reading gives each row's class, the signature of each class, and the number of documents of each n-gram;
2. n-grams in more than ``hot`` documents (counted over the whole corpus) are ordered last, all others by hash. A pair
   at the threshold must share one of the first ``n - ceil(t n) + 1`` n-grams of that order, so a class enters the
   tiles of those n-grams only. In a tile of at most ``hot`` classes pairs inside the size band are candidates, and
   bitmap signatures bound their overlap from above before they may connect two classes;
3. larger tiles are not paired, whatever n-gram they belong to: each is a star around its smallest class;
4. candidates make coarse components, a superset of the true ones. Each is cut into blocks of bounded size ordered by
   set size. Blocks are checked alone, then each with the next one in size, then any two of a component whose classes
   are not all connected by then: bitmap bound first, then exact intersection of the sorted arrays. Classes that are
   already connected are not compared again, so a family of near copies, however large, ships each set three times;
5. the exact links make the final components.

Every text is read in full. A class is named by 64 bits; a second 64-bit sum tells when two different sets share that
name, and such names are then made from both sums, so an identity has 128 bits. No pair list of a hot group is ever made. Two
blocks of one coarse component that stay unconnected are compared with each other, so a component of B blocks with no
true links costs O(B^2) shipped blocks.

Filters that executors hold are sized from counted keys; beyond ``FILTER_BYTES`` that of wanted classes is cut into
parts, each a reading of the texts, and that of hot n-grams keeps to those in the most documents. A reducer of counts
holds the share of one range of n-gram names; there are RANGES ranges for each input split or more.

Edge cases: null or empty text has an empty set and links with nothing; fewer words than ``n`` give one n-gram;
repeated rows and equal texts share a class; a null id never becomes a component's id unless all its ids are null; a
very long text is one set, hashed in segments; an empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Least 64-bit words of a bitmap signature; it grows with the set so that it never fills up.
LANES = 8
#: Bits of an n-gram's identity while documents are counted; more n-grams sharing one only changes an order.
COUNT_BITS = 40
#: N-grams held in a task before it hands over counts.
FLUSH = 4_000_000
#: Ranges of n-gram names for each input split.
RANGES = 8
#: Bits of a filter a key, and bytes of a filter (or a part of it) that an executor holds.
KEY_BITS, FILTER_BYTES = 32, 64 << 20
#: N-grams in a block of a tile (8 bytes each).
BLOCK = 1_000_000


ROW_NAMES = ["doc_id", "mark", "n_shingles", "class_key", "check", "bits"]
ROW_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
#: Kinds of what a tile gives: candidate pairs, links of a star, and (n-gram, centre) of a star.
PAIR, STAR, CENTRE = 0, 1, 2


@dataclass(frozen=True)
class Similarity:
    """Links need ``100 * intersection >= percent * union`` over distinct ``n``-word shingles.

    Classes carry ``name_bits`` bits of their first sum, as long as no two share it; fewer only make clashes likelier.
    """

    n: int = 5
    percent: int = 80
    hot: int = 48
    name_bits: int = 64

    def prefix(self, size):
        return size - -(-self.percent * size // 100) + 1

    def enough(self, overlap, total):
        """For set sizes adding up to ``total``."""
        return (100 + self.percent) * overlap >= self.percent * total


def shingles(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    words, first = c.hashed_words(column)
    keys = np.zeros(len(words), np.uint64)
    if len(words) >= n:
        last = len(words) - n + 1
        for k in range(n):
            keys[:last] += words[k : k + last] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) % (1 << 64) | 1)
        keys = c.mix(keys)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            grams = np.sort(keys[a : b - n + 1])
            out.append(grams[np.concatenate(([True], grams[1:] != grams[:-1]))])
        elif b > a:
            short = words[a:b] * c.mix(np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(977))
            out.append(c.mix(np.array([short.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_FIRST, _SECOND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def set_sum(grams: np.ndarray, salt: np.uint64, bits: int = 64) -> int:
    """The top bits of a 64-bit sum over a set and its size, as a signed long."""
    total = c.mix(grams ^ salt).sum(dtype=np.uint64)
    return int((c.mix(np.array([total + np.uint64(len(grams))], np.uint64)) >> np.uint64(64 - bits)).view(np.int64)[0])


def class_key(grams: np.ndarray, rule: Similarity, clashes: frozenset = frozenset()) -> int:
    """Name of a set: its first sum, or one made from both where different sets share the first."""
    key = set_sum(grams, _FIRST, rule.name_bits)
    return both_sums(key, set_sum(grams, _SECOND)) if key in clashes else key


def both_sums(key: int, check: int) -> int:
    pair = np.array([key, check], np.int64).view(np.uint64)
    return int(c.mix(pair[:1] + c.mix(pair[1:])).view(np.int64)[0])


def lanes_of(size: int) -> int:
    """64-bit words of a set's signature: a power of two with at least two bits an element."""
    return max(LANES, 1 << (2 * size - 1).bit_length() - 6 if size > 32 else 0)


def bitmap(grams: np.ndarray, lanes: int) -> bytes:
    bits = np.zeros(lanes * 64, bool)
    bits[(grams >> np.uint64(20)) & np.uint64(lanes * 64 - 1)] = True
    return np.packbits(bits).tobytes()


def fold(bits: np.ndarray, lanes: int) -> np.ndarray:
    """Signatures (rows) at a smaller power-of-two width: the bit of an element is its hash modulo the width."""
    while bits.shape[1] > lanes:
        bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
    return bits


def classes(batches: Iterator[pa.RecordBatch], rule: Similarity, clashes: frozenset) -> Iterator[tuple[int, np.ndarray]]:
    """(key, set) of each class once a task; empty sets are left out."""
    seen: set[int] = set()
    for batch in c.pieces(batches, "text"):
        for grams in shingles(c.column_of(batch, "text"), rule.n):
            if len(grams) and (key := class_key(grams, rule, clashes)) not in seen:
                seen.add(key)
                yield key, grams


# --------------------------------------------------------------------- counting documents, rows and signatures
def _runs(batches, rule: Similarity, ranges: int) -> Iterator[pa.RecordBatch]:
    """What one reading of the texts gives: (part, gaps, more).

    Parts from 0 hold the distinct n-grams of a task as sorted runs, one for each range of identities, with counts.
    Parts below 0 hold, in ``gaps``, Arrow streams of ROW_NAMES: every row of the input, with the signature where the
    task meets a class first. They are dealt out by turns.
    """
    shift, span = np.uint64(64 - COUNT_BITS), (1 << COUNT_BITS) // ranges

    def sent(rows):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "gaps", "more"])

    def run(held):
        ids, times = np.unique(np.concatenate(held) >> shift, return_counts=True)
        cuts = np.searchsorted(ids, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(span))
        rows = [(r, ids[a:b] - np.uint64(r * span), times[a:b]) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return sent([(r, _pack(np.diff(x, prepend=np.uint64(0))), _pack(t - 1)) for r, x, t in rows])

    seen: set[tuple] = set()
    held, size = [], 0
    turn = TaskContext.get().partitionId() * 7919
    for batch in c.pieces(batches, "text"):
        found = shingles(c.column_of(batch, "text"), rule.n)
        keys = [set_sum(x, _FIRST, rule.name_bits) if len(x) else None for x in found]
        checks = [set_sum(x, _SECOND) if len(x) else None for x in found]
        bits = [None] * len(found)
        for k, (name, grams) in enumerate(zip(zip(keys, checks, strict=True), found, strict=True)):
            if len(grams) and name not in seen:
                seen.add(name)
                bits[k] = bitmap(grams, lanes_of(len(grams)))
                held.append(grams)
                size += len(grams)
        columns = [c.column_of(batch, "doc_id"), c.column_of(batch, "mark"), [len(x) for x in found], keys, checks, bits]
        rows = pa.RecordBatch.from_arrays([x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(columns, ROW_KINDS, strict=True)], ROW_NAMES)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_batch(rows)
        turn += 1
        yield sent([(-1 - turn % ranges, sink.getvalue().to_pybytes(), b"")])
        if size >= FLUSH:
            yield run(held)
            held, size = [], 0
    if held:
        yield run(held)


def _pack(values: np.ndarray) -> bytes:
    """Integers below 2**40 by planes of bytes; planes that are all zero at the top are left out."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = max([0, *(k + 1 for k in range(5) if planes[k].any())])
    return bytes([used]) + planes[:used].tobytes()


def _unpack(blob: bytes, count: int | None = None) -> np.ndarray:
    used = blob[0]
    count = (len(blob) - 1) // used if used else count
    out = np.zeros((count, 8), np.uint8)
    out[:, :used] = np.frombuffer(blob, np.uint8, count * used, 1).reshape(used, count).T
    return out.view("<u8").ravel()


def _merged(table: pa.Table, hot: int) -> pa.Table:
    """Rows as they were sent (parts below 0), or the n-grams of a range in more than ``hot`` documents."""
    found = []
    part = table.column("part")[0].as_py()
    if part < 0:
        rows = pa.concat_tables(pa.ipc.open_stream(x.as_py()).read_all() for x in table.column("gaps"))
        return rows.add_column(0, "part", pa.array(np.full(len(rows), part), pa.int32()))
    for gaps, more in zip(table.column("gaps"), table.column("more"), strict=True):
        ids = np.cumsum(_unpack(gaps.as_py(), 1))
        found.append((ids, _unpack(more.as_py(), len(ids)) + np.uint64(1)))
    ids, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    df = np.bincount(at, np.concatenate([x for _, x in found])).astype(np.int64)
    keep = df > hot
    none = [pa.nulls(int(keep.sum()), kind) for kind in ROW_KINDS[2:]]
    return pa.table([pa.array(np.full(keep.sum(), part), pa.int32()), ids[keep].astype(np.int64), df[keep], *none], ["part", *ROW_NAMES])


def counted_rows(rows: DataFrame, rule: Similarity) -> tuple[DataFrame, np.ndarray, frozenset]:
    """ROW_NAMES of every row, the filter of hot n-grams, and first sums that different sets share.

    Hot are n-grams in more than ``rule.hot`` documents, named by their top ``COUNT_BITS`` bits. Every n-gram of every
    text is counted, exact copies once a task. Where the filter would exceed FILTER_BYTES, the bar doubles until the
    rest fit, and so it does for a false hit: any bar gives the same links, since an n-gram is only ordered by it, and
    a tile of more than ``rule.hot`` classes is a star anyway. ``bits`` is there at least once for each class.
    """
    splits = max(rows.rdd.getNumPartitions(), 32)
    ranges = 1 << (RANGES * splits - 1).bit_length()
    hot = rule.hot
    runs = rows.mapInArrow(lambda it: _runs(it, rule, ranges), "part int, gaps binary, more binary")
    merged = c.checkpointed(runs.groupBy("part").applyInArrow(lambda t: _merged(t, hot), "part int, doc_id long, mark long, n_shingles long, class_key long, check long, bits binary"))
    counts = merged.where("part >= 0").select("part", F.col("doc_id").alias("id"), F.floor(F.log2(F.col("mark") / hot)).alias("level"))
    tally = {r["level"]: r["n"] for r in counts.groupBy("level").agg(F.count("*").alias("n")).collect()}  # at most 64 rows
    level = next(k for k in range(64) if sum(n for at, n in tally.items() if at >= k) * KEY_BITS <= FILTER_BYTES * 8)
    span = (1 << COUNT_BITS) // ranges
    names = counts.where(F.col("level") >= level).select((F.col("part").cast("long") * span + F.col("id")).alias("key"))
    named = merged.where("part < 0").select(*ROW_NAMES)
    sums = named.where("class_key is not null").groupBy("class_key").agg(F.min("check").alias("a"), F.max("check").alias("b"))
    # Of 1e10 sets about three pairs share a first sum.
    clashes = frozenset(r["class_key"] for r in sums.where("a <> b").select("class_key").collect())
    if clashes:
        apart = F.udf(both_sums, "long")
        named = named.withColumn("class_key", F.when(F.col("class_key").isin(*clashes), apart("class_key", "check")).otherwise(F.col("class_key")))
    return named, filter_of(names, sum(n for at, n in tally.items() if at >= level)), clashes


# ------------------------------------------------------------------------------------------- candidates
def _prefixes(batches, rule: Similarity, hot: np.ndarray, clashes: frozenset) -> Iterator[pa.RecordBatch]:
    """(shingle, is_hot, key, size) for the first n-grams of each class, hot ones last."""

    def flush():
        sizes = [len(x) for x, _, _ in held]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([x for x, _, _ in held]).view(np.int64)),
                pa.array(np.concatenate([x for _, x, _ in held])),
                pa.array(np.repeat(np.array([k[0] for _, _, k in held], np.int64), sizes)),
                pa.array(np.repeat(np.array([k[1] for _, _, k in held], np.int32), sizes)),
            ],
            ["shingle", "is_hot", "key", "size"],
        )

    held, size = [], 0
    for key, grams in classes(batches, rule, clashes):
        p = rule.prefix(len(grams))
        is_hot = filter_has(hot, (grams >> np.uint64(64 - COUNT_BITS)).view(np.int64))
        cold = grams[~is_hot][:p]
        late = grams[is_hot][: p - len(cold)]
        held.append((np.concatenate((cold, late)), np.arange(p) >= len(cold), (key, len(grams))))
        size += p
        if size >= 100_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _tiles(batches, rule: Similarity) -> Iterator[pa.RecordBatch]:
    """(kind, a, b) from rows sorted by shingle and size.

    Classes of an n-gram in at most ``rule.hot`` of them pair up inside the size band; those of a larger tile form a star
    around the smallest. Of a hot n-gram a task has a share only; its centre is named so that the shares can be joined.
    """

    def given(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    for tile in c.sorted_runs(batches, "shingle"):
        columns = [tile.column(x).to_numpy() for x in ("shingle", "key", "size")]
        is_hot = tile.column("is_hot").to_numpy()
        shingle, key, size = (x[~is_hot] for x in columns)
        if len(key):
            starts = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
            sizes = np.diff(starts, append=len(key))
            if sizes.max() > rule.hot:
                large = np.repeat(sizes > rule.hot, sizes)
                around = np.repeat(np.minimum.reduceat(key, starts), sizes)
                yield given(STAR, around[large & (around != key)], key[large & (around != key)])
                shingle, key, size = (x[~large] for x in (shingle, key, size))
        size = size.astype(np.int64)
        lag = 1
        while lag < len(key):
            same = np.flatnonzero(shingle[lag:] == shingle[:-lag])
            if not len(same):
                break
            a, b = same, same + lag
            ok = (key[a] != key[b]) & (100 * size[a] >= rule.percent * size[b])
            a, b = a[ok], b[ok]
            if len(a):
                yield given(PAIR, np.minimum(key[a], key[b]), np.maximum(key[a], key[b]))
            lag += 1
        shingle, key, _ = (x[is_hot] for x in columns)
        if len(key):
            starts = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
            centre = np.minimum.reduceat(key, starts)
            around = np.repeat(centre, np.diff(starts, append=len(key)))
            yield given(STAR, around[around != key], key[around != key])
            yield given(CENTRE, shingle[starts], centre)


def _wanted(batches, rule: Similarity, wanted: np.ndarray, part: int, parts: int, clashes: frozenset) -> Iterator[pa.RecordBatch]:
    """(key, mark, size, data) of the rows that may be wanted, by their marks; data is the set itself."""

    def flush():
        data = [x.tobytes() for _, _, x in held]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in held], pa.int64()), pa.array([m for _, m, _ in held], pa.int64()), pa.array([len(x) for _, _, x in held], pa.int32()), pa.array(data, pa.binary())], ["key", "mark", "size", "data"])

    held, size = [], 0
    for batch in batches:
        marks = c.column_of(batch, "mark").to_numpy(zero_copy_only=False)
        rows = batch.filter(pa.array(filter_has(wanted, marks) & (marks % parts == part)))
        for piece in c.pieces([rows], "text"):
            for mark, grams in zip(c.column_of(piece, "mark").to_pylist(), shingles(c.column_of(piece, "text"), rule.n), strict=True):
                if len(grams):
                    held.append((class_key(grams, rule, clashes), mark, grams))
                    size += len(grams)
                    if size >= BLOCK:
                        yield flush()
                        held, size = [], 0
    if held:
        yield flush()


def wanted_classes(rows: DataFrame, rule: Similarity, keys: DataFrame, clashes: frozenset) -> DataFrame:
    """(key, size, data) once for each class of ``keys`` (key, mark), where mark names the one row that it is read from."""
    spark, count = rows.sparkSession, keys.count()
    parts = max(1, -(-count * KEY_BITS // (FILTER_BYTES * 8)))

    def reader(wanted, part: int):
        return lambda it: _wanted(it, rule, wanted.value, part, parts, clashes)

    found = []
    for part in range(parts):
        own = keys.select(F.col("mark").alias("key")).where(F.pmod("key", F.lit(parts)) == part)
        found.append(rows.select("mark", "text").mapInArrow(reader(spark.sparkContext.broadcast(filter_of(own, -(-count // parts))), part), "key long, mark long, size int, data binary"))
    found = reduce(DataFrame.unionByName, found)
    # Rows repeating an id and a text share a mark, and a few marks only pass the filter.
    return found.join(keys.select("key", "mark"), ["key", "mark"]).dropDuplicates(["key"]).select("key", "size", "data")


def filter_has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in a filter; its number of bits is a power of two."""
    at = c.mix(keys.view(np.uint64)) >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def filter_of(keys: DataFrame, count: int) -> np.ndarray:
    """A filter of ``count`` longs ``key``, built by the executors in slices of 512 bytes; false hits only cost time."""
    log = max(12, (max(count, 1) * KEY_BITS - 1).bit_length())
    log -= (1 << log) > FILTER_BYTES * 8

    def slices(batches):
        for batch in batches:
            at = c.mix(c.column_of(batch, "key").to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - log)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(12)).astype(np.int32)), pa.array((at & np.uint64(4095)).astype(np.int32))], ["slice", "bit"])

    def merge(table):
        bits = np.zeros(4096, bool)
        bits[table.column("bit").to_numpy()] = True
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    made = keys.select("key").mapInArrow(slices, "slice int, bit int").distinct().groupBy("slice").applyInArrow(merge, "slice int, bits binary").toArrow()
    out = np.zeros((1 << log - 12, 512), np.uint8)
    for at, bits in zip(made.column("slice").to_pylist(), made.column("bits").to_pylist(), strict=True):
        out[at] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _bounded(batches, rule: Similarity) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps leave room for enough overlap: |x & y| <= (|x| + |y| - differing bits) / 2."""
    for batch in (part.slice(k, 8192) for part in batches for k in range(0, part.num_rows, 8192)):
        xa, xb = (c.column_of(batch, k).to_pylist() for k in ("xa", "xb"))
        total = c.column_of(batch, "na").to_numpy().astype(np.int64) + c.column_of(batch, "nb").to_numpy()
        widths = np.array([(len(x), len(y)) for x, y in zip(xa, xb, strict=True)])
        most = np.empty(len(total), np.int64)
        for wa, wb in np.unique(widths, axis=0).tolist():
            at = np.flatnonzero((widths[:, 0] == wa) & (widths[:, 1] == wb))
            x, y = (np.frombuffer(b"".join([v[k] for k in at]), np.uint64).reshape(len(at), -1) for v in (xa, xb))
            lanes = min(wa, wb) // 8
            most[at] = (total[at] - np.bitwise_count(fold(x, lanes) ^ fold(y, lanes)).sum(1, dtype=np.int64)) // 2
        ok = pa.array(rule.enough(most, total))
        yield pa.RecordBatch.from_arrays([c.column_of(batch, "a").filter(ok), c.column_of(batch, "b").filter(ok)], ["a", "b"])


# ------------------------------------------------------------------------------------------- exact check
def spanning_links(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray, sets: list[np.ndarray], side: np.ndarray, rule: Similarity) -> list[tuple[int, int]]:
    """Links that connect what is connected by links; rows come by size. Between two blocks only pairs across count."""
    label, links = np.arange(len(keys)), []
    two = len(set(side.tolist())) > 1
    for i in range(len(keys) - 1):
        to = int(np.searchsorted(sizes, 100 * sizes[i] // rule.percent, "right"))
        js = np.arange(i + 1, to)
        js = js[label[js] != label[i]]
        if two:
            js = js[side[js] != side[i]]
        if not len(js):
            continue
        total = sizes[js] + sizes[i]
        js = js[rule.enough((total - np.bitwise_count(bits[js] ^ bits[i]).sum(1, dtype=np.int64)) // 2, total)]
        for j in js.tolist():
            if label[j] == label[i]:
                continue
            a, b = sets[i], sets[j]
            at = np.searchsorted(b, a)
            overlap = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            if rule.enough(overlap, len(a) + len(b)):
                links.append((int(keys[i]), int(keys[j])))
                label[label == label[j]] = label[i]
    return links


def _verify(batches, rule: Similarity) -> Iterator[pa.RecordBatch]:
    for run in c.sorted_runs(batches, "tile"):
        tile = run.column("tile").to_numpy()
        cuts = [0, *np.flatnonzero(tile[1:] != tile[:-1]) + 1, len(tile)]
        links = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = run.slice(a, b - a)
            sizes = part.column("size").to_numpy().astype(np.int64)
            order = np.argsort(sizes, kind="stable")
            data = part.column("data").to_pylist()
            sets = [np.frombuffer(data[k], np.uint64) for k in order]
            # One width for the tile, that of its largest set unless the signatures would exceed 64 MB.
            lanes = lanes_of(len(sets[-1]))
            while lanes > LANES and lanes * 8 * len(sets) > 64 << 20:
                lanes //= 2
            bits = np.frombuffer(b"".join([bitmap(x, lanes) for x in sets]), np.uint64).reshape(-1, lanes)
            links += spanning_links(part.column("key").to_numpy()[order], sizes[order], bits, sets, part.column("block").to_numpy()[order], rule)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def exact_links(rows: DataFrame, coarse: DataFrame, rule: Similarity, clashes: frozenset) -> DataFrame:
    """Spanning links (a, b) of each coarse component, checked in tiles of one or two blocks.

    ``coarse`` has (key, component, size, mark). A set is shuffled once by its key and once to each of its tiles.
    """
    # Blocks by set size: bands of 2**(1/8) in size first, so that a window never has to hold a whole component.
    band = F.floor(F.log2(F.col("size").cast("double")) * 8)
    salt = F.when(F.col("many"), F.pmod(F.xxhash64("key"), F.ceil(F.col("weight") / BLOCK))).otherwise(F.lit(0))
    whole = coarse.groupBy("component").agg(F.sum("size").alias("total"))
    banded = coarse.groupBy("component", band.alias("band")).agg(F.sum("size").alias("weight"))
    placed = (
        coarse.withColumn("band", band)
        .join(whole, "component")
        .join(banded, ["component", "band"])
        .withColumn("many", F.col("total") > BLOCK)
        .withColumn("band", F.when(F.col("many"), F.col("band")).otherwise(F.lit(0)))
        .withColumn("salt", salt)
        .select("key", "component", F.xxhash64("component", "band", "salt").alias("block"), "size", "mark")
    )
    placed = c.checkpointed(placed)

    def checked(members: DataFrame, wanted: DataFrame) -> DataFrame:
        sets = wanted_classes(rows, rule, wanted, clashes).join(members, "key").select("tile", "block", "key", "size", "data")
        return c.checkpointed(sets.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda it: _verify(it, rule), "a long, b long"))

    def of_tiles(tiles: DataFrame) -> DataFrame:
        """Links of tiles (block, block2); only sets of their blocks are read."""
        tiles = tiles.select("block", "block2", F.xxhash64("block", "block2").alias("tile"))
        sides = tiles.select("tile", "block").union(tiles.select("tile", "block2"))
        members = c.checkpointed(sides.join(placed, "block").select("key", "mark", "tile", "block"))
        return checked(members.drop("mark"), members.select("key", "mark").distinct())

    links = checked(placed.select("key", F.col("block").alias("tile"), "block"), placed)
    blocks = placed.groupBy("component", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    blocks = c.checkpointed(blocks.withColumn("n", F.count("*").over(Window.partitionBy("component"))).where("n > 1").drop("n"))
    if blocks.isEmpty():
        return links
    following = Window.partitionBy("component").orderBy("low", "high", "block")
    ring = blocks.withColumn("block2", F.lead("block").over(following)).withColumn("low2", F.lead("low").over(following)).where("block2 is not null")
    ring = c.checkpointed(ring.where(F.col("low2") * rule.percent <= F.col("high") * 100).select("block", "block2"))
    links = links.union(of_tiles(ring))
    label = c.components(links).toDF("key", "label")
    own = placed.join(blocks.select("block"), "block", "left_semi").join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    pure = own.groupBy("block").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    left = blocks.join(pure, "block")
    right = left.toDF(*(x if x == "component" else f"{x}2" for x in left.columns))
    near = (F.col("low") * rule.percent <= F.col("high2") * 100) & (F.col("low2") * rule.percent <= F.col("high") * 100)
    connected = (F.col("least") == F.col("most")) & (F.col("least2") == F.col("most2")) & (F.col("least") == F.col("least2"))
    rest = left.join(right, "component").where((F.col("block") < F.col("block2")) & near & ~connected).select("block", "block2")
    done = ring.select(F.least("block", "block2").alias("block"), F.greatest("block", "block2").alias("block2"))
    rest = c.checkpointed(rest.join(done, ["block", "block2"], "left_anti"))
    return links if rest.isEmpty() else links.union(of_tiles(rest))


def ngram_components(docs: DataFrame, rule: Similarity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, component, class_key) for every row of ``docs``; see the module's text.

    ``mark`` is ``row_mark`` of the row, which names its id and text. ``component`` is the smallest class of the
    component: where rows repeat an id with different texts, two components may have the same smallest id.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_mark(id_col, text_col).alias("mark"))
    spark = docs.sparkSession
    named, names, clashes = counted_rows(rows, rule)
    hot = spark.sparkContext.broadcast(names)
    entries = rows.select("text").mapInArrow(lambda it: _prefixes(it, rule, hot.value, clashes), "shingle long, is_hot boolean, key long, size int")

    # Hot n-grams are salted by class, since one of them may hold a large part of all classes.
    salt = F.when(F.col("is_hot"), F.pmod("key", F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))).otherwise(F.lit(0))
    dealt = entries.withColumn("salt", salt).repartition("shingle", "salt").sortWithinPartitions("shingle", "size")
    tiles = c.checkpointed(dealt.mapInArrow(lambda it: _tiles(it, rule), "kind int, a long, b long").distinct())
    pairs = tiles.where(F.col("kind") == PAIR).select("a", "b")
    shares = tiles.where(F.col("kind") == CENTRE).select(F.col("a").alias("shingle"), "b")
    centres = shares.groupBy("shingle").agg(F.min("b").alias("a"))
    stars = tiles.where(F.col("kind") == STAR).select("a", "b").union(shares.join(centres, "shingle").where("a <> b").select("a", "b").distinct())

    keys = tiles.where(F.col("kind") != CENTRE).select(F.explode(F.array("a", "b")).alias("key")).union(shares.select("b")).distinct()
    marks = named.where("bits is not null").select(F.col("class_key").alias("key"), F.col("n_shingles").cast("int").alias("size"), "bits", "mark")
    marks = c.checkpointed(marks.join(keys, "key", "left_semi").groupBy("key").agg(F.min("size").alias("size"), F.min("bits").alias("data"), F.min("mark").alias("mark")))
    of = marks.select("key", "size", "data")
    bounded = (
        pairs.join(of.toDF("a", "na", "xa"), "a")
        .join(of.toDF("b", "nb", "xb"), "b")
        .select("a", "b", "na", "nb", "xa", "xb")
        .mapInArrow(lambda it: _bounded(it, rule), "a long, b long")
    )
    coarse = c.components(bounded.union(stars)).withColumnRenamed("node", "key").join(marks.select("key", "size", "mark"), "key")
    final = c.components(exact_links(rows, coarse, rule, clashes)).withColumnRenamed("node", "key")
    return _labelled(named.select("doc_id", "mark", "n_shingles", "class_key"), final)


def row_mark(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), text_col)


def _labelled(named: DataFrame, final: DataFrame) -> DataFrame:
    least = named.where("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("least"))
    least = least.join(final.toDF("class_key", "component"), "class_key", "left").withColumn("component", F.coalesce("component", "class_key"))
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    rows = named.join(least.join(ids, "component").select("class_key", "component", "component_id"), "class_key", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "mark", "n_shingles", own.alias("component_id"), "component", "class_key")


def keep_one(docs: DataFrame, rule: Similarity) -> DataFrame:
    """One document of each component stays; documents without words all stay. Columns of ``docs`` come back unchanged.

    The smallest id stays, and where several texts of the component have it, the one of the smallest ``row_mark``. Rows of
    one id whose texts are not similar are in components of their own. Of rows repeating id and text one stays, the
    first by the hash of all its columns. Rows without an id cannot be named by another and stay.
    """
    found = ngram_components(docs, rule).where("doc_id is not null and n_shingles > 0")
    stay = found.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("w")).select("w.doc_id", "w.mark").distinct()
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(c.WORD_PATTERN), F.lit(False))
    rows = docs.where(~alone).select(F.col("doc_id").cast("long").alias("doc_id"), row_mark("doc_id", "text").alias("mark"), F.struct(*docs.columns).alias("own"), F.xxhash64(*docs.columns).alias("first"))
    once = rows.join(stay, ["doc_id", "mark"], "left_semi").groupBy("doc_id", "mark").agg(F.min_by("own", "first").alias("own"))
    return once.select("own.*").unionByName(docs.where(alone))
