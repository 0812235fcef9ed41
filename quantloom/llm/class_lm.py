"""LM scoring with a Brown class-based bigram model.

P(word | previous) = P(class | previous class) * P(word | class). Everything is learnt from the training documents
(crc32(doc_id as text) mod 7 is not 2), all of them and whole:

1. unigram counts of all words, by hash, aggregated map side and then by key;
2. the neighbours of every word are written once, by word: those that executors hold as numbers with a side and a
   count, and of two neighbours that are both not held each as the other's hash. All rounds read these, and no text;
3. bigram counts among the ``CORE`` most frequent words; exchange clustering on the driver moves one word at a time to
   the class that raises the mutual information of adjacent classes most (the counts have at most CORE**2 cells). These
   are only the classes to start from;
4. at most ``PASSES`` rounds of exchange over every training word: the classes beside each word are gathered by word,
   and each word goes where the objective gains most against the class bigram table of the round. All words of a round
   move at once; a round that does not raise the objective is undone and ends the search. A word that executors do not
   hold carries its neighbours and tells them its class, so that a round has one shuffle and no join;
5. class transitions over the whole training corpus, smoothed towards the class unigram; emissions by adding one, with
   one more slot in each class for unseen words. An unseen word is summed over the classes it could have.

Executors hold counts and classes of the frequent words (at or above the smallest count that leaves at most
``LEXICON`` of them, 17 bytes each), which saves shuffling them; those of all other words are joined by a shuffle, so
what a word gets does not depend on where it is held. A document starts and ends in the end token's class.

Edge cases: null or empty text is one end token; repeated rows and ids are scored each; without training words
the score equals the base score; a null id is a training document; a very long text is tokenised whole, in a batch
of its own; an empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

CORE, CLASSES, ROUNDS, PASSES = 1200, 48, 6, 3
LEXICON = 1 << 19
#: Strength of the class unigram in a transition.
ALPHA = 5.0
#: The end token's name among word hashes.
END = np.uint64(0xE0D)
#: Classes with the end token's, which is the last and fixed; as a class of scoring, SIDES is that of unseen words.
SIDES = CLASSES + 1
#: Of a word, its slots: class before, SIDES + class after, the word itself on both sides, OWN + its class or -1.
SELF, OWN = 2 * SIDES, 2 * SIDES + 2
#: Tokens that a task aggregates at a time.
HELD = 1_000_000
#: Of a neighbour that executors hold, its cell: 2 * its number + side (0 before, 1 after); of the word itself, ITSELF.
ITSELF = 2 * LEXICON + 2
#: Bits of a cell's count; more than that is repeated.
TIMES = 32 - (ITSELF + 2).bit_length()
SPREAD = 1 << 20
#: Of a word that executors do not hold, a neighbour that they do not hold either, and 2 * how often + the side it has it on.
TELL = np.dtype([("word", "<u8"), ("mark", "<u4")])
#: Words seen at most so often have their gains looked up.
RARE = 64
#: Rows among which those of equal sides are moved once.
ALIKE = 1 << 16


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text's words, and each text's first token (one more at the end)."""
    words, first = c.hashed_words(column)
    at = first + np.arange(len(first))
    out = np.empty(len(words) + len(first) - 1, np.uint64)
    ends = at[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = words, END
    return out, at


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in c.pieces(batches, "text"):
        yield tokens(c.column_of(batch, "text"))


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, before, at) of many texts: tokens and the tokens before them as indices of the sorted words."""
    held, size = [], 0

    def flush():
        words, at = np.unique(np.concatenate([x for x, _ in held] + [[END]]).astype(np.uint64), return_inverse=True)
        at, end = at[:-1], at[-1]
        before = np.roll(at, 1)
        start = 0
        for x, first in held:
            before[start + first[:-1]] = end
            start += len(x)
        return words, before, at

    for words, first in _training(batches):
        held.append((words, first))
        size += len(words)
        if size >= HELD:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    for words, _ in _training(batches):
        held.append(words)
        size += len(words)
        if size >= 8_000_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


class Lexicon:
    """Sorted word hashes with counts and ids (a class, or a rank); a missing word has count 0 and the given id."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, ids: np.ndarray, missing: int):
        order = np.argsort(words)
        self.words, self.counts, self.ids, self.missing = words[order], counts[order].astype(np.int64), ids[order].astype(np.int32), missing

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(present, id, count) of each word."""
        if not len(self.words):
            return np.zeros(len(words), bool), np.full(len(words), self.missing, np.int32), np.zeros(len(words), np.int64)
        own, back = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
        here = self.words[at] == own
        return here[back], np.where(here, self.ids[at], self.missing)[back], np.where(here, self.counts[at], 0)[back]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of each word by the exchange algorithm; words come by falling count, the first ones seed the classes.

    The objective is sum f(N(a, b)) - sum f(N(a, .)) - sum f(N(., b)) with f(x) = x log x: the part of the bigram
    likelihood that depends on the classes. Each word is taken out and put where the objective gains most.
    """
    n = len(pairs)
    own = np.arange(n) % classes
    to = np.zeros((n, classes))  # from word to class
    of = np.zeros((n, classes))  # from class to word
    for k in range(classes):
        to[:, k], of[:, k] = pairs[:, own == k].sum(1), pairs[own == k].sum(0)
    joint = np.zeros((classes, classes))
    for k in range(classes):
        joint[k] = to[own == k].sum(0)
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            a, self_pair = own[w], pairs[w, w]
            right, left = to[w].copy(), of[w].copy()
            right[a] -= self_pair
            left[a] -= self_pair
            joint[a] -= right
            joint[:, a] -= left
            joint[a, a] -= self_pair
            sent, got = right.sum() + self_pair, left.sum() + self_pair
            # Putting w into k adds right to row k, left to column k and, at the crossing, both and the self pair.
            rows = (_xlogx(joint + right) - _xlogx(joint)).sum(1) - _row_part(joint, right)
            columns = (_xlogx(joint + left[:, None]) - _xlogx(joint)).sum(0) - _row_part(joint, left)
            cross = np.diagonal(joint)
            gain = rows + columns + _xlogx(cross + right + left + self_pair) - _xlogx(cross)
            out, into = joint.sum(1), joint.sum(0)
            gain -= _xlogx(out + sent) - _xlogx(out) + _xlogx(into + got) - _xlogx(into)
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else a
            joint[b] += right
            joint[:, b] += left
            joint[b, b] += self_pair
            if b != a:
                moved += 1
                own[w] = b
                to[:, a] -= pairs[:, w]
                to[:, b] += pairs[:, w]
                of[:, a] -= pairs[w]
                of[:, b] += pairs[w]
        if not moved:
            break
    return own


def _row_part(joint: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The diagonal's share of a row or column sum, which is accounted for at the crossing."""
    diagonal = np.diagonal(joint)
    return _xlogx(diagonal + add) - _xlogx(diagonal)


def _packed(words: np.ndarray, cells: np.ndarray, times: np.ndarray, distinct: bool = False) -> pa.RecordBatch:
    """(word, seen) from cells index of word * 256 + slot: seen holds times * 256 + slot in 4 bytes, repeated where they overflow."""
    if not distinct:
        cells, at = np.unique(cells, return_inverse=True)
        times = np.bincount(at, times, len(cells)).astype(np.int64)
    most = (1 << 24) - 1
    if len(times) and times.max() > most:
        parts = -(-times // most)
        cells, last = np.repeat(cells, parts), np.cumsum(parts) - 1
        times, rest = np.full(len(cells), most), times - (parts - 1) * most
        times[last] = rest
    who = cells >> 8
    starts = np.flatnonzero(np.diff(who, prepend=-1))
    offsets = np.append(starts, len(cells)) * 4
    seen = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer((times * 256 + (cells & 255)).astype(np.uint32))])
    return pa.RecordBatch.from_arrays([pa.array(words[who[starts]].view(np.int64)), seen], ["word", "seen"])


def _unpacked(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, cells, times) of rows (word, seen), which may repeat a word."""
    words, index = np.unique(table.column("word").to_numpy().view(np.uint64), return_inverse=True)
    seen = table.column("seen")
    data, sizes = [], []
    for part in seen.chunks if isinstance(seen, pa.ChunkedArray) else [seen]:
        part = part.cast(pa.large_binary())
        offsets = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)
        data.append(np.frombuffer(part.buffers()[2], np.uint32, (offsets[-1] - offsets[0]) // 4, offsets[0]).astype(np.int64))
        sizes.append(np.diff(offsets) // 4)
    data = np.concatenate(data)
    return words, np.repeat(index, np.concatenate(sizes)) * 256 + (data & 255), data >> 8


def _blobs(rows: np.ndarray, n: int, data: np.ndarray) -> pa.Array:
    """A binary value for each of ``n`` rows from items in the order of their ``rows``."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _items(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(items, how many each value has) of a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    size = np.dtype(kind).itemsize
    many = (offsets[-1] - offsets[0]) // size
    return np.frombuffer(column.buffers()[2], kind, many, offsets[0]) if many else np.zeros(0, kind), np.diff(offsets) // size


def _neighbours(train: DataFrame, shared, path: str | None = None) -> DataFrame:
    """(word, away, n, beside, apart): of every word how often it is seen, its held neighbours and how often it follows itself.

    ``away`` tells that executors do not hold it; such a word has one row, and in ``apart`` its neighbours that are away
    as well. A table over the whole corpus, written to ``path``, by default one of its own in the shared folder.

    A word seen more than SPREAD times has several rows, so that no task holds all of a frequent word's neighbours.
    """

    def run(batches):
        most, turn = 1 << TIMES, TaskContext.get().partitionId()
        for words, before, at in _streams(batches):
            here, number, n = shared.value.find(words)
            number = number.astype(np.int64)
            same = before == at
            into, out = ~same & here[before], ~same & here[at]
            cells = np.concatenate(((at[into] << 32) + number[before[into]] * 2, (before[out] << 32) + number[at[out]] * 2 + 1, (at[same] << 32) + ITSELF))
            cells, times = np.unique(cells, return_counts=True)
            if len(times) and times.max() > most:
                parts = -(-times // most)
                last = np.cumsum(parts) - 1
                rest = times - (parts - 1) * most
                cells, times = np.repeat(cells, parts), np.full(parts.sum(), most)
                times[last] = rest
            packed = ((cells & 0xFFFFFFFF) << TIMES) + times - 1
            both = ~(same | here[before] | here[at])
            pair, often = np.unique(before[both] * len(words) + at[both], return_counts=True)
            left, right = pair // len(words), pair % len(words)
            who, told, mark = np.concatenate((left, right)), np.concatenate((right, left)), np.concatenate((often * 2, often * 2 + 1))
            order = np.argsort(who, kind="stable")
            tell = np.empty(len(order), TELL)
            tell["word"], tell["mark"] = words[told[order]], mark[order]
            salt = turn % np.maximum(n // SPREAD, 1)
            seen = np.bincount(at, minlength=len(words))
            columns = [pa.array(words.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(~here), pa.array(seen)]
            yield pa.RecordBatch.from_arrays([*columns, _blobs(cells >> 32, len(words), packed.astype(np.uint32)), _blobs(who[order], len(words), tell)], ["word", "salt", *names])

    def joined(batches):
        # Rows of a word follow each other, and so do their bytes.
        for table in c.sorted_runs(batches, "word"):
            table = table.combine_chunks()
            word = table.column("word").chunk(0)
            starts = np.unique(np.concatenate(([0], np.flatnonzero(np.diff(word.to_numpy())) + 1)))
            n = np.add.reduceat(table.column("n").to_numpy(), starts)
            blobs = []
            for x in ("beside", "apart"):
                x = table.column(x).chunk(0).cast(pa.large_binary())
                offsets = np.frombuffer(x.buffers()[1], np.int64, len(x) + 1, x.offset * 8)
                ends = np.append(offsets[starts], offsets[-1])
                blobs.append((ends, pa.py_buffer(np.frombuffer(x.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0]) if ends[-1] > ends[0] else b"")))
            for a in range(0, len(starts), 1 << 14):
                at = pa.array(starts[a : a + (1 << 14)])
                out = [word.take(at), table.column("away").chunk(0).take(at), pa.array(n[a : a + (1 << 14)])]
                for ends, data in blobs:
                    part = ends[a : a + len(at) + 1]
                    own = data.slice(int(part[0] - ends[0]), int(part[-1] - part[0]))
                    out.append(pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(part - part[0]), own]).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["word", *names])

    names, kinds = ["away", "n", "beside", "apart"], "away boolean, n long, beside binary, apart binary"
    rows = train.mapInArrow(run, f"word long, salt int, {kinds}")
    path = path or f"{c.place_of(train.sparkSession)}/neighbours-{uuid.uuid4().hex}"
    rows = rows.repartition("word", "salt").sortWithinPartitions("word").drop("salt")
    rows.mapInArrow(joined, f"word long, {kinds}").write.option("compression", "zstd").parquet(path)
    return train.sparkSession.read.schema(f"word long, {kinds}").parquet(path)


def _cells_of(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, row, cell, times) of neighbour rows."""
    data, many = _items(c.column_of(batch, "beside"), np.uint32)
    data = data.astype(np.int64)
    return c.column_of(batch, "word").to_numpy().view(np.uint64), np.repeat(np.arange(len(many)), many), data >> TIMES, (data & ((1 << TIMES) - 1)) + 1


def _core_pairs(neighbours: DataFrame, core: np.ndarray, shared) -> np.ndarray:
    """Counts of (previous, word) among the core words, from the neighbours that are before them."""
    rank = np.full(len(shared.value.words) + 2, -1)
    rank[np.searchsorted(shared.value.words, core)] = np.arange(len(core))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                words, row, cell, times = _cells_of(batch)
                own = rank[np.searchsorted(shared.value.words, words)][row]
                before = np.where(cell == ITSELF, own, np.where(cell & 1 == 0, rank[np.minimum(cell >> 1, len(rank) - 1)], -1))
                use = before >= 0
                pair, index = np.unique(before[use] * len(core) + own[use], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.bincount(index, times[use], len(pair)).astype(np.int64))], ["pair", "n"])

    few = neighbours.select("word", "beside").where(F.col("word").isin(core.view(np.int64).tolist()))
    rows = few.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most CORE**2 rows
    out = np.zeros(len(core) ** 2)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(len(core), len(core))


def _gathered(neighbours: DataFrame, away: DataFrame, shared) -> DataFrame:
    """(word, seen, beside, apart) of every training word: its class and count, and the classes beside it over the whole corpus.

    ``neighbours`` are read for the words that executors hold; ``away`` has the others, with class and neighbours, which
    they keep. Such a word's row tells its class to its neighbours.
    """

    def kinds_of(lexicon):
        kinds = np.append(np.repeat(lexicon.ids.astype(np.int64), 2), np.zeros(max(ITSELF + 1 - 2 * len(lexicon.ids), 0), np.int64))
        slots = np.where(kinds < 0, -1, kinds + np.arange(len(kinds)) % 2 * SIDES)
        slots[ITSELF] = SELF
        return slots

    def own(slots, words, k, n, row, cell, times):
        slot = slots[cell]
        use = slot >= 0
        at = np.concatenate((row[use] * 256 + slot[use], np.arange(len(words)) * 256 + OWN + k))
        times = np.concatenate((times[use], n))
        if len(at) < 8 * len(words):
            return _packed(words, at, times)
        sums = np.bincount(at, times, len(words) * 256)
        at = np.flatnonzero(sums)
        return _packed(words, at, sums[at].astype(np.int64), True)

    def row_of(packed, beside=None, apart=None):
        empty = pa.nulls(packed.num_rows, pa.binary())
        return pa.RecordBatch.from_arrays([*packed.columns, empty if beside is None else beside, empty if apart is None else apart], ["word", "seen", "beside", "apart"])

    def known(batches):
        lexicon = shared.value
        slots = kinds_of(lexicon)
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(a, 1 << 12)
                words, row, cell, times = _cells_of(part)
                k = lexicon.ids[np.searchsorted(lexicon.words, words)].astype(np.int64)
                yield row_of(own(slots, words, k, c.column_of(part, "n").to_numpy(), row, cell, times))

    def told(batches):
        lexicon = shared.value
        slots = kinds_of(lexicon)
        parts, size = [], 0

        def flush():
            at, times, word, mark, k = map(np.concatenate, zip(*parts))
            yield row_of(_packed(lexicon.words, at, times))
            words, index = np.unique(word, return_inverse=True)
            yield row_of(_packed(words, index * 256 + (mark & 1) * SIDES + k, mark >> 1))

        for batch in batches:
            if not batch.num_rows:
                continue
            words, row, cell, times = _cells_of(batch)
            k = c.column_of(batch, "k").to_numpy().astype(np.int64)
            beside, apart = c.column_of(batch, "beside"), c.column_of(batch, "apart")
            yield row_of(own(slots, words, k, c.column_of(batch, "n").to_numpy(), row, cell, times), beside, apart)
            tell, many = _items(apart, TELL)
            whose = np.repeat(k, many)
            use, say = (k[row] >= 0) & (cell != ITSELF), whose >= 0
            # A neighbour before the word has it after itself.
            parts.append(((cell[use] >> 1) * 256 + (1 - (cell[use] & 1)) * SIDES + k[row[use]], times[use], tell["word"][say], tell["mark"][say].astype(np.int64), whose[say]))
            size += len(row) + len(tell)
            if size >= 2 * HELD:
                yield from flush()
                parts, size = [], 0
        if parts:
            yield from flush()

    def whole(batches):
        for table in c.sorted_runs(batches, "word"):
            words, cells, times = _unpacked(table)
            kept = table.select(["word", "beside", "apart"]).filter(table.column("beside").is_valid())
            at = np.full(len(words), -1)
            at[np.searchsorted(words, kept.column("word").to_numpy().view(np.uint64))] = np.arange(kept.num_rows)
            at = pa.array(at, mask=at < 0)
            yield row_of(_packed(words, cells, times), *(kept.column(x).combine_chunks().take(at) for x in ("beside", "apart")))

    kind = "word long, seen binary, beside binary, apart binary"
    rows = neighbours.where("not away").select("word", "n", "beside").mapInArrow(known, kind).union(away.mapInArrow(told, kind))
    return c.checkpointed(rows.repartition("word").sortWithinPartitions("word").mapInArrow(whole, kind))


def _sides(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(words, own class, count, (word, class, times) before, the same after, times beside itself)."""
    words, cells, times = _unpacked(table)
    if (np.diff(cells) == 0).any():
        cells, at = np.unique(cells, return_inverse=True)
        times = np.bincount(at, times).astype(np.int64)
    who, slot = cells >> 8, cells & 255
    own, n, twice = np.full(len(words), -1), np.zeros(len(words), np.int64), np.zeros(len(words))
    at = slot >= OWN - 1
    own[who[at]], n[who[at]] = slot[at] - OWN, times[at]
    at = slot == SELF
    twice[who[at]] = times[at]
    left, right = slot < SIDES, (slot >= SIDES) & (slot < SELF)
    return words, own, n, (who[left], slot[left], times[left]), (who[right], slot[right] - SIDES, times[right]), twice


def joint_of(gathered: DataFrame) -> np.ndarray:
    """Counts of (previous class, class) over the words that have a class."""

    def run(batches):
        total = np.zeros(SIDES * SIDES)
        for batch in batches:
            if batch.num_rows:
                _, own, _, (who, k, times), _, twice = _sides(batch)
                use = own[who] >= 0
                total += np.bincount(k[use] * SIDES + own[who[use]], times[use], SIDES * SIDES)
                use = own >= 0
                total += np.bincount(own[use] * (SIDES + 1), twice[use], SIDES * SIDES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["pair", "n"])

    rows = gathered.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIDES * SIDES)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(SIDES, SIDES)


def information(joint: np.ndarray) -> float:
    """The part of the bigram likelihood that depends on the classes."""
    return _xlogx(joint).sum() - _xlogx(joint.sum(1)).sum() - _xlogx(joint.sum(0)).sum()


def gains(joint: np.ndarray, own: np.ndarray, left, right, twice: np.ndarray) -> np.ndarray:
    """What the objective gains, but for a constant of the word, when each word alone is put into each class.

    ``left`` and ``right`` are (word, class, times) by word; a word whose class is -1 is not in ``joint`` yet. Its own
    share is taken out of the class it is in. Only classes beside a word count, so rare words cost little.
    """
    n, size = len(own), len(joint)
    l, r = np.zeros((n, size)), np.zeros((n, size))  # noqa: E741
    l[left[0], left[1]], r[right[0], right[1]] = left[2], right[2]
    is_own = np.arange(size) == own[:, None]
    out = np.zeros((n, size))
    for (who, k, times), table, mine, other in ((right, joint.T, r, l), (left, joint, l, r)):
        for a in range(0, len(who), 1 << 13):
            w, j, t = who[a : a + (1 << 13)], k[a : a + (1 << 13)], times[a : a + (1 << 13), None].astype(float)
            x = table[j] - is_own[w] * t
            corner = np.flatnonzero(j == own[w])
            x[corner] -= other[w[corner]] + is_own[w[corner]] * twice[w[corner], None]
            d = _xlogx(x + t) - _xlogx(x)
            d[np.arange(len(w)), j] = 0
            starts = np.flatnonzero(np.diff(w, prepend=-1))
            out[w[starts]] += np.add.reduceat(d, starts)
    cross = l + r + twice[:, None]
    x = np.diagonal(joint) - is_own * cross
    out += _xlogx(x + cross) - _xlogx(x)
    for sums, add in ((joint.sum(1), r.sum(1) + twice), (joint.sum(0), l.sum(1) + twice)):
        x = sums - is_own * add[:, None]
        out -= _xlogx(x + add[:, None]) - _xlogx(x)
    return out


def steps(joint: np.ndarray) -> tuple[np.ndarray, ...]:
    """What x log x grows by, from each cell, transposed cell, row sum and column sum, when 0 to RARE is added."""
    t = np.arange(RARE + 1.0)
    grow = lambda x: _xlogx(x[None] + t.reshape(-1, *([1] * x.ndim))) - _xlogx(x)[None]
    return grow(joint), grow(joint.T), grow(joint.sum(1)), grow(joint.sum(0))


def rare_gains(joint: np.ndarray, own: np.ndarray, left, right, table: tuple[np.ndarray, ...]) -> np.ndarray:
    """``gains`` of words seen at most RARE times and never beside themselves, from the table of ``steps``.

    Only a word's own class, from which it is taken out first, and the crossings need logarithms of their own.
    """
    n, size = len(own), len(joint)
    l, r = np.zeros((n, size)), np.zeros((n, size))  # noqa: E741
    l[left[0], left[1]], r[right[0], right[1]] = left[2], right[2]
    out = np.zeros((n, size))
    placed = np.flatnonzero(own >= 0)
    lost = lambda x, t: _xlogx(x) - _xlogx(x - t)
    for (who, k, times), grown, cells, other in ((right, table[1], joint.T, l), (left, table[0], joint, r)):
        for a in range(0, len(who), 1 << 14):
            w, j, t = who[a : a + (1 << 14)], k[a : a + (1 << 14)], times[a : a + (1 << 14)]
            d = grown[t, j]
            back = np.flatnonzero(own[w] >= 0)
            d[back, own[w[back]]] = lost(cells[j[back], own[w[back]]], t[back])
            corner = np.flatnonzero(j == own[w])  # the word's own class, which all of its other side leaves
            x = cells[j[corner]] - other[w[corner]]
            d[corner] = _xlogx(x + t[corner, None]) - _xlogx(x)
            d[np.arange(len(w)), j] = 0
            starts = np.flatnonzero(np.diff(w, prepend=-1))
            out[w[starts]] += np.add.reduceat(d, starts)
    cross = l + r
    w, j = np.nonzero(cross)
    x = np.diagonal(joint)[j] - (own[w] == j) * cross[w, j]
    out[w, j] += _xlogx(x + cross[w, j]) - _xlogx(x)
    for sums, grown, add in ((joint.sum(1), table[2], r.sum(1)), (joint.sum(0), table[3], l.sum(1))):
        add = add.astype(np.int64)
        d = grown[add]
        d[placed, own[placed]] = lost(sums[own[placed]], add[placed])
        out -= d
    return out


def _moved(gathered: DataFrame, joint: np.ndarray) -> DataFrame:
    """(word, n, k, beside, apart): each word in the class where the objective gains most against ``joint``."""
    # An empty class suits each word best alone, so all would crowd into it at once.
    empty = joint[:CLASSES].sum(1) + joint[:, :CLASSES].sum(0) == 0

    def of(side, take):
        at = np.full(len(take), -1)
        at[take] = np.arange(take.sum())
        use = take[side[0]]
        return at[side[0][use]], side[1][use], side[2][use]

    def best_of(batch, table):
        """(n, class, whether the class is the word's own matter) of rows."""
        words, own, n, left, right, twice = _sides(batch)
        rare = (n <= RARE) & (twice == 0)
        gain = np.empty((len(words), len(joint)))
        gain[rare] = rare_gains(joint, own[rare], of(left, rare), of(right, rare), table)
        gain[~rare] = gains(joint, own[~rare], of(left, ~rare), of(right, ~rare), twice[~rare])
        gain = np.where(empty, -np.inf, gain[:, :CLASSES])
        best = gain.argmax(1)
        rows = np.arange(len(words))
        stays = ((own >= 0) & (gain[rows, best] <= gain[rows, np.clip(own, 0, CLASSES - 1)] + 1e-9)) | (own == CLASSES)
        bare = (own < 0) & (empty.all() | (np.bincount(left[0], minlength=len(words)) + np.bincount(right[0], minlength=len(words)) == 0))
        return n, np.where(stays, own, best), bare & ~stays

    def run(batches):
        table = steps(joint)
        held, size = [], 0

        def flush():
            rows = pa.Table.from_batches(held)
            words = rows.column("word").to_numpy().view(np.uint64)
            # Words with equal classes beside them, counts and class move alike.
            seen = rows.column("seen").combine_chunks().dictionary_encode()
            alike = seen.dictionary
            parts = []
            for a in range(0, len(alike), 4096):
                part = alike.slice(a, 4096)
                parts.append(best_of(pa.RecordBatch.from_arrays([pa.array(np.arange(len(part))), part], ["word", "seen"]), table))
            at = seen.indices.to_numpy()
            n, k, bare = (np.concatenate(x)[at] for x in zip(*parts))
            k = np.where(bare, (words % np.uint64(CLASSES)).astype(np.int64), k)
            out = pa.table([rows.column("word"), pa.array(n), pa.array(k.astype(np.int32)), rows.column("beside"), rows.column("apart")], names=["word", "n", "k", "beside", "apart"])
            yield from out.to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= ALIKE:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return c.checkpointed(gathered.mapInArrow(run, "word long, n long, k int, beside binary, apart binary"))


def _lexicon(classes: DataFrame, held) -> Lexicon:
    rows = classes.where(held).toArrow()
    return Lexicon(rows.column("word").to_numpy().view(np.uint64), rows.column("n").to_numpy(), rows.column("k").to_numpy(), -2)


def fit(train: DataFrame) -> dict:
    """Counts and classes of all words (a checkpointed table) and the bounded model; ``train`` has a column text."""
    spark = train.sparkSession
    counts = c.checkpointed(train.mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The smallest count that leaves a bounded lexicon, from a histogram of at most 16 rows an octave.
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    tally = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("level")).collect()
    least, have = 1 << 62, 0  # words seen once are as well joined as held
    for row in tally:
        have += row["words"]
        if have > LEXICON or row["n"] < 2:
            break
        least = row["n"]
    held = (F.col("n") >= least) | (F.col("word") == int(END))
    model = {"N": int(total["n"]), "V": int(total["v"]), "held": held}
    head = _lexicon(counts.withColumn("k", F.when(F.col("word") == int(END), CLASSES).otherwise(-1).cast("int")), held)
    order = np.lexsort((head.words, -head.counts))
    core = head.words[order][head.words[order] != END][:CORE]
    if model["V"] < 2:  # no word but the end token
        return model | {"lexicon": head, "classes": counts.withColumn("k", F.lit(-1)), "trans": None}
    numbered = Lexicon(head.words, head.counts, np.arange(len(head.words)), -1)
    by_number = spark.sparkContext.broadcast(numbered)
    beside = f"{c.place_of(spark)}/neighbours-{uuid.uuid4().hex}"
    neighbours = _neighbours(train, by_number, beside)
    c.release(counts)
    pairs = _core_pairs(neighbours, core, by_number)
    first = Lexicon(np.append(core, END), np.zeros(len(core) + 1), np.append(exchange(pairs, CLASSES, ROUNDS), CLASSES), -1)
    lexicon = Lexicon(head.words, head.counts, first.find(head.words)[1], -2)
    away, classes = neighbours.where("away").select("word", "n", F.lit(-1).alias("k"), "beside", "apart"), None
    kept = None
    # The tables of a round go once the next one's are there; what stays are the classes of the best round.
    for k in range(PASSES + 1):
        gathered = _gathered(neighbours, away, spark.sparkContext.broadcast(lexicon))
        joint = joint_of(gathered)
        if kept and information(joint) <= information(kept[2]):
            c.release(gathered, classes)
            break
        if kept:
            c.release(kept[0])
        if k:  # before, not all words had a class
            kept = classes, lexicon, joint
        if k < PASSES:
            classes = _moved(gathered, joint)
            lexicon = _lexicon(classes, held)
            away = classes.where(~held)
        c.release(gathered)
    c.remove(spark, beside)
    classes, lexicon, trans = kept
    classes = classes.select("word", "n", "k")
    mass, kinds = np.zeros(SIDES), np.zeros(SIDES)
    for row in classes.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[row["k"]], kinds[row["k"]] = row["n"], row["v"]
    unigram = (trans.sum(0) + 1) / (trans.sum() + SIDES)
    chance = np.vstack(((trans + ALPHA * unigram) / (trans.sum(1, keepdims=True) + ALPHA), unigram))
    slots = mass + kinds
    slots[:CLASSES] += 1  # unseen words
    unseen = chance[:, :CLASSES] @ (1 / slots[:CLASSES])
    return model | {"lexicon": lexicon, "classes": classes, "trans": np.log10(np.column_stack((chance, unseen))), "slots": np.log10(slots)}


def _cells(doc: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, key) in order: keys, how often, where each doc's begin (one more), and the cell of each input."""
    order = np.lexsort((key, doc))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1])
    starts = np.flatnonzero(new)
    cell = np.empty(len(doc), np.int64)
    cell[order] = np.cumsum(new) - 1
    return key[order][starts], np.diff(np.append(starts, len(doc))), np.searchsorted(doc[order][starts], np.arange(rows + 1)), cell


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    n_all, v = model["N"], model["V"]
    shared = docs.sparkSession.sparkContext.broadcast({k: model.get(k) for k in ("lexicon", "trans", "slots")})

    def run(batches):
        held = shared.value
        for batch in c.pieces(batches, "text"):
            words, first = tokens(c.column_of(batch, "text"))
            here, ids, n = held["lexicon"].find(words)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            total = lambda x, at: np.bincount(doc[at], x, batch.num_rows)
            base = total(np.log10((n[here] + 1) / (n_all + v + 1)), here)
            tail, times, cuts, cell = _cells(doc[~here], words[~here], batch.num_rows)
            # Of each token, its class as -1 - class, or its place among the words of its row that are joined.
            code = -1 - ids.astype(np.int64)
            code[~here] = cell - cuts[doc[~here]]
            before = np.roll(code, 1)
            before[first[:-1]] = -1 - CLASSES
            own = base
            open_ = (code >= 0) | (before >= 0)
            if held["trans"] is not None:
                sure = ~open_
                own = total(np.log10(n[here] + 1) - held["slots"][ids[here]], here) + total(held["trans"][-1 - before[sure], -1 - code[sure]], sure)
            pair, often, at, _ = _cells(doc[open_], (before[open_] << 32) + code[open_] + SIDES, batch.num_rows)
            lists = lambda cuts, x: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays(
                [c.column_of(batch, "doc_id"), *(pa.array(x) for x in (np.diff(first), np.bincount(doc[here], minlength=batch.num_rows), base, own)), lists(cuts, tail.view(np.int64)), lists(cuts, times.astype(np.int32)), lists(at, pair), lists(at, often.astype(np.int32))],
                ["doc_id", *names],
            )

    def finish(batches):
        held = shared.value
        for batch in batches:
            get = lambda x: c.column_of(batch, x)
            times, often, found = get("times"), get("often"), get("found")
            sizes, marks = (x.value_lengths().to_numpy(zero_copy_only=False) for x in (times, often))
            starts = np.cumsum(sizes) - sizes
            rows = lambda n: np.repeat(np.arange(batch.num_rows), n)
            flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
            k, n = np.full(sizes.sum(), SIDES), np.zeros(sizes.sum(), np.int64)
            many = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            hits = found.flatten()
            at = starts[rows(many)] + hits.field("pos").to_numpy(zero_copy_only=False)
            k[at], n[at] = hits.field("k").to_numpy(zero_copy_only=False), hits.field("n").to_numpy(zero_copy_only=False)
            doc, m = rows(sizes), flat(times)
            base = np.bincount(doc, m * np.log10((n + 1) / (n_all + v + 1)), batch.num_rows)
            own = base
            if held["trans"] is not None:
                own = np.bincount(doc, m * np.where(n > 0, np.log10(n + 1) - np.append(held["slots"], 0)[k], 0), batch.num_rows)
                doc, pair = rows(marks), flat(get("pair"))
                before, code = pair >> 32, (pair & 0xFFFFFFFF) - SIDES
                put = lambda x: np.where(x < 0, -1 - x, np.append(k, 0)[np.where(x < 0, 0, starts[doc] + x)])
                own = own + np.bincount(doc, flat(often) * held["trans"][put(before), put(code)], batch.num_rows)
            known = get("n_known").to_numpy() + np.bincount(np.repeat(np.arange(batch.num_rows), sizes), m * (n > 0), batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [get("doc_id"), get("n_tokens"), pa.array(known), pa.array(get("base_score").to_numpy() + base), pa.array(get("score").to_numpy() + own)], ["doc_id", "n_tokens", "n_known", "base_score", "score"]
            )

    kinds = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double", "words": "array<long>", "times": "array<int>", "pair": "array<long>", "often": "array<int>"}
    names = list(kinds)
    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id", *(F.lit(None).cast(k).alias(x) for x, k in kinds.items())).schema
    rows = c.checkpointed(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    away = model["classes"].where(~model["held"])
    found = rows.select("row", F.posexplode("words").alias("pos", "word")).join(away, "word").groupBy("row").agg(F.collect_list(F.struct("pos", "k", "n")).alias("found"))
    whole = rows.drop("words").join(found, "row", "left").mapInArrow(finish, rows.select("doc_id", *names[:4]).schema)
    return whole.select("doc_id", c.is_remainder(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def class_lm(docs: DataFrame) -> DataFrame:
    train = docs.where(~c.is_remainder(F.col("doc_id"), 7, 2)).select("text")
    return score(docs, fit(train))
