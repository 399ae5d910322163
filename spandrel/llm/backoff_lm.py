"""Scoring texts with a weighted backoff automaton learnt from the corpus.

States are n-grams, each with arcs for the words seen often enough after it and a
failure arc to its longest proper suffix.  An arc weighs the discounted relative
frequency; the failure arc weighs what the arcs leave, divided by what the shorter
state gives to the other words, so that every state's probabilities sum to one.
The root gives each word its smoothed relative frequency over all training tokens.
A text is read once from left to right; the state is carried from word to word and
log-probabilities add up.

Every n-gram that occurs at least LEAST_COUNT times is in the model, whatever the
size of the corpus, so none of it has to fit a worker.  What a read adds up is a sum
over the n-grams of the text, each giving a fixed weight: what its arc adds to the
arc of its suffix, less the failure arc that it saves, and its own failure arc.  The
weights are a distributed table made by aggregations and joins; it is dealt into shards
by fingerprint, a text's n-grams go to the shards that know them, and what each shard
adds to a text comes back as one row.  N-grams with a share of all tokens are sent to
every worker instead (a share e is reached by 1 / e n-grams of a length at most), so
that no shard has a hot key.  Shards grow in number with the corpus, not in size.
Bit maps of bounded size tell of most n-grams that they are too rare before they
are shuffled; a full bit map tells less and loses none.  ``train`` makes the same
model as states and arcs in memory, for a corpus small enough; tests compare the two.

Tokens: maximal runs of other than ASCII white space with A-Z in lower case, then
one end.  Words are told apart by 64-bit fingerprints.

Edge cases: a null or empty text is one end token; a null key counts as training;
repeated rows are all answered and counted; without training rows all words are
unknown; an empty table gives an empty result; extra columns are never touched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import base, textbytes
from .base import OWN_KEY, cut, discard, read, ship, slices, stored, text_buffer

#: Share of all training tokens from which an n-gram's weights are sent to every worker.
HOT_SHARE = 5e-7
#: Training tokens for each shard of the model.
SHARD_TOKENS = 4_000_000
#: An n-gram of the model occurs at least so often.
LEAST_COUNT = 2
ORDER = 3
DISCOUNT = 0.75
SMOOTHING = 0.1
END = 0  # a fingerprint that no word has
BEGIN = 0x2545F4914F6CDD1D  # of the mark before a text, a context only
#: Bits of a bit map of fingerprints, as a power of two.
_MAP_BITS = 27
#: Units in which gains, and sums of logarithms on their way back from a shard, are whole numbers.
GAIN_UNIT, LOG_UNIT = 2e-8, 1e-10
_SHIFT = np.int64(20)
_TALLY = 600_000
#: Bytes of text that are worked on at once.
_SLICE = 1_000_000


def held_out(key: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where in it each distinct one starts; which of several equal keys comes first is left open."""
    by = np.argsort(keys)
    ascending = keys[by]
    return by, np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), ascending[1:] != ascending[:-1])))


def _totals(counts: np.ndarray, by: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each distinct key's counts."""
    return np.add.reduceat(counts[by], starts) if len(starts) else np.zeros(0, np.int64)


class Tally:
    """Counts of 64-bit keys with memory for a bounded number; hands out what it has when full."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        by, starts = _grouped(keys)
        keys, counts = keys[by[starts]], _totals(counts, by, starts)
        self.parts, self.size = [(keys, counts)], len(keys)
        return keys, counts

    def batches(self, last: bool):
        """Counts to emit: nothing while there is room, all at the end."""
        if self.size >= 2 * _TALLY or (last and self.parts):
            keys, counts = self.merged()
            if last or len(keys) >= _TALLY:
                for i in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], ["h", "c"])
                self.parts, self.size = [], 0


def _token_prints(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all tokens, each text's end after its words, and the offsets of the texts."""
    raw, offsets = text_buffer(batch.column("text"))
    prints, at = textbytes.prints(raw, offsets)
    out = np.insert(prints.view(np.int64), at[1:], np.int64(END))
    return out, at + np.arange(len(at))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of n-grams from those of their prefixes and suffixes, one word shorter."""
    return textbytes.mix(a.view(np.uint64) * np.uint64(0xA0761D6478BD642F) + textbytes.mix(b.view(np.uint64) + np.uint64(1))).view(np.int64)


def _shard(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """64-bit integers as bytes: all first bytes, all second ones and so on, which repeat, compressed."""
    data = x.astype("<i8").view(np.uint8).reshape(len(x), 8).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], 8 * n, "zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(8, n).T.copy().view("<i8").ravel().astype(np.int64)


def packed_keys(sorted_keys: np.ndarray) -> bytes:
    """Ascending unsigned fingerprints by their differences."""
    return packed(np.diff(sorted_keys.view(np.uint64), prepend=np.uint64(0)).view(np.int64))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data).view(np.uint64), dtype=np.uint64).view(np.int64)


def bit_map(known: DataFrame) -> np.ndarray:
    """Words of 64 bits: which values the first bits of the fingerprints ``h`` take."""
    word, bit = F.shiftrightunsigned("h", 64 - _MAP_BITS + 6).cast("int"), F.shiftrightunsigned("h", 64 - _MAP_BITS).bitwiseAND(F.lit(63)).cast("int")
    table = known.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
    out = np.zeros(1 << (_MAP_BITS - 6), np.uint64)
    out[table.column("w").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where a fingerprint is surely not among those of the bit map."""
    at = keys.view(np.uint64) >> np.uint64(64 - _MAP_BITS)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _ngrams(batch: pa.RecordBatch, maps: list[np.ndarray], longest: int):
    """Per length up to ``longest``: fingerprints, prefixes, suffixes and text numbers of the n-grams whose parts the maps may hold; then the offsets.

    The first are all words, the end and the begin mark among them.
    """
    prints, at = _token_prints(batch)
    keys = np.insert(prints, at[:-1], np.int64(BEGIN))
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at) + 1)
    out = [(keys, keys, keys, rows)]
    place = np.arange(len(keys))
    for k in range(1, longest):
        held = in_map(maps[k - 1], keys)
        if k == 1:
            held |= keys == BEGIN
        # Neighbours in place whose parts are held, within one text.
        first = np.flatnonzero(held[:-1] & held[1:] & (np.diff(place) == 1) & (rows[1:] == rows[:-1]))
        a, b = keys[first], keys[first + 1]
        keys, rows, place = combine(a, b), rows[first], place[first]
        out.append((keys, a, b, rows))
    return out, at


def count_pairs(training: DataFrame, maps, shards: int = 1) -> DataFrame:
    """``(h, a, b, c)``: every n-gram that occurs at least LEAST_COUNT times, its prefix, suffix and count.  ``maps``: a broadcast bit map for each shorter length."""

    def count(batches):
        tally = PairTally()
        for batch in slices(batches, "text", _SLICE):
            tally.add(*_ngrams(batch, maps.value, len(maps.value) + 1)[0][-1][:3])
            if tally.size >= 2 * _TALLY and len(tally.merged()[0]) >= _TALLY:
                yield tally.packed(shards)
        if tally.size:
            yield tally.packed(shards)

    def total(table: pa.Table) -> pa.Table:
        a = np.concatenate([np.cumsum(unpacked(x)) for x in table.column("a").to_pylist()])
        b, c = (np.concatenate([unpacked(x) for x in table.column(name).to_pylist()]) for name in "bc")
        h = combine(a, b)
        by, starts = _grouped(h)
        c = _totals(c, by, starts)
        kept = c >= LEAST_COUNT
        first = by[starts[kept]]
        return pa.table([pa.array(x) for x in (h[first], a[first], b[first], c[kept])], names=["h", "a", "b", "c"])

    ship(__name__, base.__name__, textbytes.__name__)
    counted = training.select("text").mapInArrow(count, "shard int, a binary, b binary, c binary")
    return counted.groupBy("shard").applyInArrow(total, "h bigint, a bigint, b bigint, c bigint")


class PairTally:
    """Like Tally, of n-grams by fingerprint with their prefixes and suffixes."""

    def __init__(self):
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        by, starts = _grouped(keys)
        first = by[starts]
        self.parts.append([keys[first], a[first], b[first], np.diff(starts, append=len(keys))])
        self.size += len(first)

    def merged(self) -> list[np.ndarray]:
        keys, a, b, c = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        by, starts = _grouped(keys)
        first = by[starts]
        self.parts = [[keys[first], a[first], b[first], _totals(c, by, starts)]]
        self.size = len(first)
        return self.parts[0]

    def packed(self, shards: int) -> pa.RecordBatch:
        """All counts, by shard and ascending prefix; the tally is empty then."""
        keys, a, b, c = self.merged()
        at = _shard(keys, shards)
        order = np.argsort(a)
        order = order[np.argsort(at[order].astype(np.min_scalar_type(shards)), kind="stable")]
        edges = np.searchsorted(at[order], np.arange(shards + 1)).tolist()
        rows = []
        for i in range(shards):
            part = order[edges[i] : edges[i + 1]]
            if len(part):
                rows.append([i, packed(np.diff(a[part], prepend=np.int64(0))), packed(b[part]), packed(c[part])])
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], ["shard", "a", "b", "c"])


def shards_for(n_tokens: int) -> int:
    return max(1, -(-n_tokens // SHARD_TOKENS))


def weights(training: DataFrame, word_counts: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[np.ndarray], int, int]:
    """The model as tables ``(h, c, word, gain)``, bit maps of its n-grams by length, and the number of training tokens and of distinct ones.

    The gains of all rows of an n-gram, in whichever table, are what it adds to the
    root's log-probability of a text, beside what its parts add, in GAIN_UNIT; ``c`` is its count.
    """
    spark = training.sparkSession
    size = word_counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("h") == END, F.col("c"))).alias("ends")).first()
    n, v, ends = size["n"] or 0, size["v"], size["ends"] or 0
    marks = spark.range(1).select(F.lit(BEGIN).cast("long").alias("h"), F.lit(ends).cast("long").alias("c"))
    nodes = word_counts.unionByName(marks).select("h", "c", ((F.col("c") + SMOOTHING) / (n + SMOOTHING * (v + 1))).alias("p"))
    tables = [word_counts.select("h", "c", F.lit(True).alias("word"), F.lit(0).alias("gain"))]
    maps = [bit_map(word_counts.filter(F.col("c") >= LEAST_COUNT))]
    before, shards = None, shards_for(n)
    units = lambda x: F.round(x / GAIN_UNIT).cast("int").alias("gain")
    for _ in range(order - 1):
        sent = spark.sparkContext.broadcast(maps)
        counted = stored(count_pairs(training, sent, shards))
        sent.unpersist()
        # One join at a time, so that the files of only one are there at once.
        prefix, suffix = nodes.select(F.col("h").alias("a"), F.col("c").alias("of")), nodes.select(F.col("h").alias("b"), F.col("p").alias("low"))
        followed = stored(counted.join(prefix, "a"))
        discard(counted)
        p = F.greatest(F.col("c") - DISCOUNT, F.lit(0.1)) / F.greatest("of", "c")
        arcs = stored(followed.join(suffix, "b").select("h", "a", "c", "of", "low"))
        discard(*filter(None, (followed, before)))
        before, arcs = arcs, arcs.withColumn("p", p)
        left, other = (F.greatest(1 - F.sum(x), F.lit(1e-12)) for x in ("p", "low"))
        fail = stored(arcs.groupBy("a").agg(F.first("of").alias("of"), F.log10(left / other).alias("back")))
        own = stored(arcs.join(fail.select("a", "back"), "a").select("h", "c", F.lit(False).alias("word"), units(F.log10(F.col("p") / F.col("low")) - F.col("back"))))
        tables += [fail.select(F.col("a").alias("h"), F.col("of").alias("c"), F.lit(False).alias("word"), units(F.col("back"))), own]
        nodes = arcs.select("h", "c", "p")
        maps = [*maps, bit_map(nodes)]
    if before is not None:
        discard(before)
    return tables, maps, n, v


def count_words(training: DataFrame) -> DataFrame:
    """``(h, c)``: every distinct token of the training texts and its count."""

    def count(batches):
        tally = Tally()
        for batch in slices(batches, "text", _SLICE):
            tally.add(_token_prints(batch)[0])
            yield from tally.batches(False)
        yield from tally.batches(True)

    ship(__name__, base.__name__, textbytes.__name__)
    return training.select("text").mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place from 1 of each key in the sorted table, 0 where it is missing."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at + 1, 0)


class Grams:
    """The frequent n-grams of each length: words by sorted fingerprints, longer ones by sorted (prefix, word) numbers."""

    def __init__(self, prints: np.ndarray, counts: np.ndarray, n_texts: int):
        order = np.argsort(prints)
        self.prints = prints[order]
        #: Number of the mark before a text; it is a context only.
        self.begin = len(prints) + 1
        self.keys: list[np.ndarray] = []
        self.counts = [np.concatenate(([0], counts[order], [n_texts]))]

    def numbers(self, batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per token, with a begin mark before each text: the number of the frequent n-gram of each length that ends there; fingerprints; offsets."""
        prints, at = _token_prints(batch)
        words = np.insert(_find(self.prints, prints), at[:-1], self.begin)
        grams = [words]
        for keys in self.keys:
            before = np.concatenate(([0], grams[-1][:-1]))
            grams.append(np.where((before > 0) & (words > 0) & (words != self.begin), _find(keys, (before << _SHIFT) | words), 0))
        return grams, prints, at

    def candidates(self, batch: pa.RecordBatch) -> np.ndarray:
        """Keys of all n-grams, one word longer than the longest known, whose prefix and suffix are frequent."""
        grams, _, _ = self.numbers(batch)
        before = np.concatenate(([0], grams[-1][:-1]))
        return ((before << _SHIFT) | grams[0])[(before > 0) & (grams[-1] > 0) & (grams[0] != self.begin)]

    def extend(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys.append(keys[order])
        self.counts.append(np.concatenate(([0], counts[order])))


class Automaton:
    """States numbered from 0, the root; arcs by ``state << 20 | word``, weighing what they add to the root's log-probability."""

    def __init__(self, grams: Grams, total: float):
        shift = int(_SHIFT)
        # The grams of length k + 1 that can be contexts are the states from first[k] on.
        sizes = [len(counts) - 1 for counts in grams.counts[: max(1, len(grams.keys))]]
        self.first = [1, *(1 + np.cumsum(sizes)).tolist()]
        self.fail, self.back = [0] * self.first[-1], [0.0] * self.first[-1]
        self.arcs: dict[int, tuple[int, float]] = {}
        self.word_log = np.log10(grams.counts[0] + SMOOTHING)
        root = (grams.counts[0] + SMOOTHING) / total
        #: Probability of each arc by its key, for the longer states that fail to its state.
        chance: dict[int, float] = {}
        suffix = np.zeros(len(grams.counts[0]), np.int64)
        for k, keys in enumerate(grams.keys):
            contexts, words = keys >> _SHIFT, keys & np.int64((1 << shift) - 1)
            # An n-gram's suffix is the suffix of its prefix, and its last word; it is frequent as well.
            shorter = words if k == 0 else _find(grams.keys[k - 1], (suffix[contexts] << _SHIFT) | words)
            suffix = np.concatenate(([0], shorter))
            counts = grams.counts[k + 1][1:]
            p = np.maximum(counts - DISCOUNT, 0.1) / np.maximum(grams.counts[k][contexts], counts)
            state = self.first[k] + contexts - 1
            to = self.first[k] + shorter - 1
            if k + 1 < len(grams.keys):
                own = self.first[k + 1] + np.arange(len(keys))
                self.fail[self.first[k + 1] : self.first[k + 2]] = to.tolist()
                to = own
            arc_keys = ((state << _SHIFT) | words).tolist()
            chance.update(zip(arc_keys, p.tolist(), strict=True))
            self.arcs.update(zip(arc_keys, zip(to.tolist(), np.log10(p / root[words]).tolist(), strict=True), strict=True))
            left, other = np.ones(len(self.fail)), np.ones(len(self.fail))
            np.subtract.at(left, state, p)
            np.subtract.at(other, state, [self.probability(self.fail[s], w, chance, root) for s, w in zip(state.tolist(), words.tolist(), strict=True)])
            for s in np.unique(state).tolist():
                self.back[s] = math.log10(max(left[s], 1e-12) / max(other[s], 1e-12))

    def probability(self, state: int, w: int, chance: dict[int, float], root: np.ndarray) -> float:
        weight = 1.0
        while True:
            found = chance.get((state << int(_SHIFT)) | w)
            if found is not None:
                return weight * found
            if state == 0:
                return weight * float(root[w])
            weight *= 10 ** self.back[state]
            state = self.fail[state]

    def read(self, words: list[int]) -> float:
        """What contexts add to the log-probability of a text given by word numbers, the begin mark first; 0 is a word of which only the root knows."""
        arcs, back, fail = self.arcs, self.back, self.fail
        shift = int(_SHIFT)
        first = self.first[0] - 1
        state, total = first + words[0], 0.0
        for w in words[1:]:
            if w:
                while True:
                    arc = arcs.get(state << shift | w)
                    if arc is not None:
                        state = arc[0]
                        total += arc[1]
                        break
                    total += back[state]
                    if state == 0:
                        state = first + w
                        break
                    state = fail[state]
            else:
                while state:
                    total += back[state]
                    state = fail[state]
        return total


def train(training: DataFrame, word_counts: DataFrame, order: int = ORDER) -> tuple[Grams, Automaton, int, int]:
    """The automaton in memory, and the number of training tokens and of distinct ones, from texts and their word counts; for up to a million words and n-grams of a length."""
    size = word_counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("h") == END, F.col("c"))).alias("ends")).first()
    n, v, ends = size["n"] or 0, size["v"], size["ends"] or 0

    def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = counts.filter(F.col("c") >= LEAST_COUNT).toArrow()
        return table.column("h").to_numpy().astype(np.int64), table.column("c").to_numpy().astype(np.int64)

    grams = Grams(*frequent(word_counts), ends)
    ship(__name__, base.__name__, textbytes.__name__)
    sc = training.sparkSession.sparkContext
    for _ in range(order - 1):
        # As bytes, which carry the class along; executors need no copy of the package.
        sent = sc.broadcast(cloudpickle.dumps(grams))

        def count(batches, sent=sent):
            known, tally = cloudpickle.loads(sent.value), Tally()
            for batch in slices(batches, "text", _SLICE):
                tally.add(known.candidates(batch))
                yield from tally.batches(False)
            yield from tally.batches(True)

        counted = training.select("text").mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
        grams.extend(*frequent(counted))
        sent.destroy()
    return grams, Automaton(grams, n + SMOOTHING * (v + 1)), n, v


_SHARDED = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("gains", pa.binary())])


def dealt_weights(table: DataFrame, shards: int) -> DataFrame:
    """``(shard, keys, counts, gains)``: rows ``(h, c, word, gain)`` of the model by the shard of their fingerprints; counts of words only, else 0."""

    def deal(batches):
        waiting: list[list[np.ndarray]] = []

        def full():
            h, c, gain = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.argsort(h.view(np.uint64))
            h, c, gain = h[order], c[order], gain[order]
            edges = np.searchsorted(_shard(h, shards), np.arange(shards + 1))
            rows = [(i, packed_keys(h[a:z]), packed(c[a:z]), packed(gain[a:z])) for i, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if a < z]
            waiting.clear()
            return pa.RecordBatch.from_pylist([dict(zip(_SHARDED.names, r, strict=True)) for r in rows], schema=_SHARDED)

        for batch in batches:
            h, c, gain = (np.array(batch.column(x), t) for x, t in (("h", np.int64), ("c", np.int64), ("gain", np.int64)))
            waiting.append([h, np.where(np.array(batch.column("word")), c, 0), gain])
            if sum(len(w[0]) for w in waiting) >= 2 * _TALLY:
                yield full()
        if waiting and sum(len(w[0]) for w in waiting):
            yield full()

    ship(__name__, base.__name__, textbytes.__name__)
    return table.select("h", "c", "word", "gain").mapInArrow(deal, "shard int, keys binary, counts binary, gains binary")


class Known:
    """Fingerprints of n-grams and what each adds: whether it is a word of the training texts, to the root's log, to that of contexts."""

    def __init__(self, h: np.ndarray, counts: np.ndarray, gains: np.ndarray):
        self.h, at = np.unique(h, return_inverse=True)
        of = np.bincount(at, counts, len(self.h))
        # What a word adds is counted from that of an unknown one; place 0 is for what is not found.
        logs = np.where(of > 0, np.log10(of + SMOOTHING) - math.log10(SMOOTHING), 0.0)
        self.adds = [np.concatenate(([0.0], x)) for x in (of > 0, logs, np.bincount(at, gains, len(self.h)) * GAIN_UNIT)]


def sums(known: Known, keys: np.ndarray, texts: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """What the n-grams found add to each of ``n`` texts, and which were not found."""
    place = _find(known.h, keys)
    # Of no n-grams at all, bincount makes whole numbers.
    return [np.bincount(texts, x[place], n).astype(np.float64) for x in known.adds], place == 0


def score(docs: DataFrame, key: str, is_training: Column, text: str = "text", order: int = ORDER) -> DataFrame:
    """Per row: ``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (the root's) and ``score`` (the automaton's), both log10."""
    key_type, original = docs.schema[key].dataType, key
    named, key = "key" if key in ("n_tokens", "n_known", "train_tokens", "base_score", "score") else key, OWN_KEY
    plain = docs.select(F.col(original).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"), is_training.alias("_training"))
    training = plain.filter("_training")
    word_counts = stored(count_words(training))
    tables, maps, n, v = weights(training, word_counts, order)
    table = tables[0]
    for other in tables[1:]:
        table = table.unionByName(other)
    hot = F.col("c") >= max(LEAST_COUNT, HOT_SHARE * n)
    # A share of the tokens bounds what comes to the driver and goes to the workers.
    found = table.filter(hot).toArrow()
    h, c, word, gain = (found.column(x).to_numpy() for x in ("h", "c", "word", "gain"))
    everywhere = Known(h.astype(np.int64), np.where(word.astype(bool), c, 0), gain.astype(np.float64))
    sent = docs.sparkSession.sparkContext.broadcast((maps, everywhere.h, everywhere.adds))
    shards = shards_for(n)
    dealt = dealt_weights(table.filter(~hot), shards)

    arrow_key = to_arrow_type(key_type)
    asked_schema = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("keys", pa.binary()), ("texts", pa.binary()), ("own", pa.list_(pa.int64())), ("key", pa.list_(arrow_key)), *((x, pa.list_(t)) for x, t in (("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("context", pa.float64())))])

    def ask(batches):
        from pyspark import TaskContext

        maps, *parts = sent.value
        hot = Known.__new__(Known)
        hot.h, hot.adds = parts
        first = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []

        def full():
            """One row for each shard that is asked; a text's own sums go to one of them."""
            keys, texts, key_parts, tokens, *own = zip(*waiting, strict=True)
            size = np.cumsum([0, *map(len, tokens)])
            keys, texts = np.concatenate(keys), np.concatenate([t + at for t, at in zip(texts, size, strict=False)])
            order = np.argsort(keys.view(np.uint64))
            keys, texts = keys[order], texts[order]
            edges = np.searchsorted(_shard(keys, shards), np.arange(shards + 1)).tolist()
            holder = textbytes.mix((first + np.arange(size[-1])).view(np.uint64)) % np.uint64(shards)
            key_column, tokens = pa.concat_arrays(key_parts), np.concatenate(tokens)
            own = [np.concatenate(x) for x in own]
            rows = []
            for i in range(shards):
                a, z = edges[i : i + 2]
                mine = np.flatnonzero(holder == i)
                if a < z or len(mine):
                    rows.append([i, first, packed_keys(keys[a:z]), packed(texts[a:z]), mine, key_column.take(pa.array(mine)), tokens[mine], own[0][mine].astype(np.int64), own[1][mine], own[2][mine]])
            waiting.clear()
            columns = [pa.array([r[k] for r in rows], asked_schema.field(k).type) for k in range(4)]
            ends = pa.array(np.cumsum([0, *(len(r[4]) for r in rows)]), pa.int32())
            for k in range(4, len(asked_schema)):
                flat = pa.concat_arrays([r[k] if isinstance(r[k], pa.Array) else pa.array(r[k]) for r in rows])
                columns.append(pa.ListArray.from_arrays(ends, flat))
            return pa.RecordBatch.from_arrays(columns, names=asked_schema.names), int(size[-1])

        for batch in slices(batches, "text", _SLICE):
            found, at = _ngrams(batch, maps, order)
            size = len(at) - 1
            own, rest = np.zeros((3, size)), []
            for k, (keys, _, _, rows) in enumerate(found):
                if k:
                    held = in_map(maps[k], keys)
                    keys, rows = keys[held], rows[held]
                # Neighbouring keys are near in the table, too.
                by = np.argsort(keys)
                keys, rows = keys[by], rows[by]
                more, missing = sums(hot, keys, rows, size)
                own += more
                rest.append((keys[missing], rows[missing]))
            keys, rows = (np.concatenate(x) for x in zip(*rest, strict=True))
            column = batch.column(key)
            waiting.append((keys, rows, column.cast(arrow_key) if column.type != arrow_key else column, np.diff(at), *own))
            if sum(len(w[0]) for w in waiting) >= _TALLY or sum(len(w[3]) for w in waiting) >= 100_000:
                out, done = full()
                first += done
                yield out
        if waiting:
            yield full()[0]

    def answer(asked: pa.Table, weights: pa.Table) -> pa.Table:
        known = Known(
            np.concatenate([np.zeros(0, np.int64), *map(unpacked_keys, weights.column("keys").to_pylist())]),
            *(np.concatenate([np.zeros(0, np.int64), *map(unpacked, weights.column(x).to_pylist())]) for x in ("counts", "gains")),
        )
        rows = []
        for batch in asked.to_batches(max_chunksize=1):
            texts = unpacked(batch.column("texts")[0].as_py())
            own = np.asarray(batch.column("own").flatten(), np.int64)
            numbers = np.unique(np.concatenate((texts, own)))
            # What the n-grams here add to each text, and the text's own sums where this shard holds them.
            more, _ = sums(known, unpacked_keys(batch.column("keys")[0].as_py()), np.searchsorted(numbers, texts), len(numbers))
            at = np.searchsorted(numbers, own)
            for x, name in zip(more, ("known", "logs", "context"), strict=True):
                x[at] += np.asarray(batch.column(name).flatten(), np.float64)
            units = (1, LOG_UNIT, LOG_UNIT)
            rows.append([batch.column("first")[0], packed(np.diff(numbers, prepend=np.int64(0))), *(packed(np.rint(x / u).astype(np.int64)) for x, u in zip(more, units, strict=True)), batch.column("own"), batch.column("key"), batch.column("n_tokens")])
        columns = [pa.array([r[k].as_py() if k == 0 else r[k] for r in rows], answered.field(k).type) for k in range(5)]
        columns += [pa.concat_arrays([r[k] for r in rows]) if rows else pa.array([], answered.field(k).type) for k in range(5, 8)]
        return pa.table(columns, schema=answered)

    def whole(table: pa.Table) -> pa.Table:
        """The texts of one row of ``first`` from the sums of all shards."""
        numbers = [np.cumsum(unpacked(x)) for x in table.column("numbers").to_pylist()]
        every, at = np.unique(np.concatenate(numbers), return_inverse=True)
        totals = [np.zeros(len(every), np.int64) for _ in range(3)]
        for x, name in zip(totals, ("known", "logs", "context"), strict=True):
            np.add.at(x, at, np.concatenate([unpacked(v) for v in table.column(name).to_pylist()]))
        own = table.column("own").combine_chunks().flatten().to_numpy()
        order = np.argsort(own)
        keys, tokens = (table.column(x).combine_chunks().flatten().take(pa.array(order)) for x in ("key", "n_tokens"))
        return pa.table([keys, tokens, pa.array(totals[0]), pa.array(totals[1] * LOG_UNIT), pa.array(totals[2] * LOG_UNIT)], names=[key, "n_tokens", "n_known", "logs", "context"])

    longs = [(x, pa.binary()) for x in ("numbers", "known", "logs", "context")]
    answered = pa.schema([("first", pa.int64()), *longs, ("own", pa.list_(pa.int64())), ("key", pa.list_(arrow_key)), ("n_tokens", pa.list_(pa.int64()))])
    ship(__name__, base.__name__, textbytes.__name__)
    name = key_type.simpleString()
    # One pass that gives a text's own sums and asks for the rest, so that its numbers always agree.
    asked = plain.select(key, "text").mapInArrow(ask, f"shard int, first bigint, keys binary, texts binary, own array<bigint>, key array<{name}>, n_tokens array<bigint>, known array<bigint>, logs array<double>, context array<double>")
    parts = asked.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(answer, f"first bigint, numbers binary, known binary, logs binary, context binary, own array<bigint>, key array<{name}>, n_tokens array<bigint>")
    whole = parts.groupBy("first").applyInArrow(whole, f"`{key}` {name}, n_tokens bigint, n_known bigint, logs double, context double")
    base_score = F.col("logs") + F.col("n_tokens") * F.lit(math.log10(SMOOTHING) - math.log10(n + SMOOTHING * (v + 1)))
    return whole.select(F.col(key).alias(named), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base_score.alias("base_score"), (base_score + F.col("context")).alias("score"))


def op2_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, "doc_id", ~held_out(F.col("doc_id")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op2_backoff_lm": op2_backoff_lm}
ORACLES: dict[str, str] = {}
