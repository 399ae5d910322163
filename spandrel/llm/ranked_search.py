"""Ranked lexical search over sharded, compressed postings, document at a time.

Each task that reads documents makes index shards of some thousand of them, with the
documents in the order of their keys.  A term's postings are gaps of places and
frequencies as variable-length bytes, in blocks of ``BLOCK`` that can be read by
themselves.  No text and no posting is shuffled to make the index; it is a table.

A search brings the postings of the queries' terms together by shard.  There a heap of
cursors, one a term, keyed by the next document, merges the postings: the cursor on top
names the last document of its block, all cursors at or before that document give what
they have up to it, and with that the documents of this stretch are complete and go to
a bounded heap keyed by score, then key.  The shards' best are ranked once more over all.
Queries are dealt in blocks too, so that a task holds one shard and one block of queries.

Scores are whole numbers: a term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``, a
document's length norm ``m = 100 - 90 + (90 n N) div L``, and a document's score the sum over the
query's terms, once each, of ``weight * ((10^9 tf) div (1000 tf + 8 m))``.  N counts the
documents that have a term, L all terms, n a document's terms, df the documents that
have the term and tf its occurrences in the document.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters with A-Z in
lower case; they are told apart by 64-bit fingerprints.

Edge cases: null and wordless texts are in no shard and no count; queries without
terms, or without a matching document, have no result; rows that share a query id are
one query of all their terms; repeated documents are ranked each; documents with equal
scores come by key, null last; empty tables give an empty result; extra columns are
never touched, keys may have any name.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base, textbytes
from .base import cut, read, ship, slices, stored, text_buffer

TOP = 10
#: Documents and bytes of text from which a shard is closed, and postings a block.
SHARD_DOCUMENTS, SHARD_BYTES, BLOCK = 16_384, 32_000_000, 1024
#: Pairs of query and term that a block of queries should hold.
QUERY_TERMS = 200_000
#: Terms that are sent to every executor at most, to leave other terms out of an index or to weigh postings; more are joined by a shuffle.
BROADCAST_TERMS = 1_000_000
#: The term of a shard's row of documents; no fingerprint is 0.
_DOCUMENTS = 0


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as bytes of seven bits each, the last without the high bit, and where each number ends."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(size.max()) if len(size) else 0):
        have = np.flatnonzero(size > i)
        more = (size[have] > i + 1).astype(np.uint8) << 7
        out[ends[have] - size[have] + i] = ((values[have] >> (7 * i)) & 127).astype(np.uint8) | more
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    if len(last) == len(raw):
        return raw.astype(np.int64)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


def term_counts(raw: np.ndarray, offsets: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term, row and frequency of each pair of row and term (of ``only`` those terms), and the number of terms of each row."""
    prints, before = textbytes.prints(raw, offsets, alnum=True)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    if only is not None:
        # Only some terms are asked for; most words are told to be none of them by 20 bits.
        some = np.zeros(1 << 20, bool)
        some[(only >> np.uint64(44)).astype(np.int64)] = True
        maybe = np.flatnonzero(some[(prints >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(only, prints[maybe]), max(len(only) - 1, 0))
        maybe = maybe[only[at] == prints[maybe]] if len(only) else maybe[:0]
        prints, row = prints[maybe], row[maybe]
    order = np.lexsort((prints, row))
    prints, row = prints[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (prints[1:] != prints[:-1]) | (row[1:] != row[:-1])))) if len(prints) else np.zeros(0, np.int64)
    return prints[new], row[new], np.diff(np.concatenate((new, [len(prints)]))) if len(new) else new, np.diff(before)


class Shard:
    """Documents gathered for one shard, and its rows."""

    def __init__(self) -> None:
        self.keys, self.parts, self.lengths, self.documents, self.bytes = [], [], [], 0, 0

    def add(self, batch: pa.RecordBatch, only: np.ndarray | None) -> None:
        raw, offsets = text_buffer(batch.column("text"))
        term, row, frequency, length = term_counts(raw, offsets, only)
        have = np.flatnonzero(length)
        place = np.cumsum(length > 0) - 1 + self.documents
        self.keys.append(batch.column("key").take(pa.array(have)))
        self.lengths.append(length[have])
        self.parts.append((term, place[row], frequency))
        self.documents += len(have)
        self.bytes += len(raw)

    def rows(self, number: int, names: list[str]):
        """The shard's row of documents, and a row for each block of postings."""
        keys = pa.concat_arrays(self.keys)
        order = pc.sort_indices(keys, null_placement="at_end").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        length = np.concatenate(self.lengths)[order]
        term, place, frequency = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        place = rank[place]
        by = np.lexsort((place, term))
        term, place, frequency = term[by], place[by], frequency[by]
        start = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        within = np.arange(len(term)) - np.repeat(start, np.diff(np.concatenate((start, [len(term)]))))
        start = np.flatnonzero(within % BLOCK == 0)
        end = np.concatenate((start[1:], [len(term)])) if len(start) else start
        gap = np.diff(place, prepend=0)
        gap[start] = place[start]
        spaces, space_ends = packed(gap)
        counts, count_ends = packed(frequency)
        pieces = lambda data, ends: [data[ends[a - 1] if a else 0 : ends[z - 1]].tobytes() for a, z in zip(start.tolist(), end.tolist(), strict=True)]
        n = len(start)
        columns = [
            pa.array(np.full(n + 1, number)), pa.array(np.concatenate(([_DOCUMENTS], term[start].view(np.int64)))), pa.array(np.concatenate(([len(length)], end - start))), pa.array([int(length.sum()), *[0] * n]),
            pa.array(np.concatenate(([0], place[start]))), pa.array(np.concatenate(([0], place[end - 1]))), pa.array([packed(length)[0].tobytes(), *pieces(spaces, space_ends)], pa.binary()), pa.array([b"", *pieces(counts, count_ends)], pa.binary()),
            pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys.take(pa.array(order))), pa.nulls(n, pa.list_(keys.type))]),
        ]
        yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=10_000)


def build_index(docs: DataFrame, key: str, text: str = "text", only: np.ndarray | None = None, shard_documents: int = SHARD_DOCUMENTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index as rows: ``shard, term, n, total, first, last, places, counts, keys``.

    A shard has a row of its documents (term 0: their number, all their terms, their terms
    each in ``places``, their keys) and one for each block of a term's postings.  ``only``:
    sorted fingerprints of the terms to index, None for all.
    """
    key_type = docs.schema[key].dataType.simpleString()
    names = ["shard", "term", "n", "total", "first", "last", "places", "counts", "keys"]

    def build(batches):
        from pyspark import TaskContext

        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch in slices(batches, "text"):
            shard.add(batch, only)
            if shard.documents >= shard_documents or shard.bytes >= shard_bytes:
                yield from shard.rows(number, names) if shard.documents else ()
                number, shard = number + 1, Shard()
        if shard.documents:
            yield from shard.rows(number, names)

    ship(__name__, base.__name__, textbytes.__name__)
    schema = f"shard bigint, term bigint, n bigint, total bigint, first bigint, last bigint, places binary, counts binary, keys array<{key_type}>"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(build, schema)


class Cursor:
    """A term's blocks of postings in one shard, read when they are first needed; what they add to a score is the same for all queries."""

    def __init__(self, weight: int, norm: np.ndarray):
        self.weight, self.norm, self.blocks, self.read = weight, norm, [], {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.read:
            _, _, places, counts = self.blocks[i]
            place, frequency = np.cumsum(unpacked(places)), unpacked(counts)
            self.read[i] = place, self.weight * ((1_000_000_000 * frequency) // (1000 * frequency + 8 * self.norm[place]))
        return self.read[i]


def merged(cursors: list[Cursor], top: int) -> list[tuple[int, int]]:
    """The ``top`` best ``(score, -place)``, best first, of all documents of the cursors with a score above 0."""
    heap = [(cursor.blocks[0][0], c, 0, 0) for c, cursor in enumerate(cursors)]
    heapq.heapify(heap)
    best: list[tuple[int, int]] = []
    while heap:
        limit = cursors[heap[0][1]].blocks[heap[0][2]][1]
        places, gains = [], []
        while heap and heap[0][0] <= limit:
            _, c, b, at = heap[0]
            place, gain = cursors[c].block(b)
            to = len(place) if cursors[c].blocks[b][1] <= limit else int(np.searchsorted(place, limit, side="right"))
            places.append(place[at:to])
            gains.append(gain[at:to])
            if to < len(place):
                heapq.heapreplace(heap, (int(place[to]), c, b, to))
            elif b + 1 < len(cursors[c].blocks):
                heapq.heapreplace(heap, (cursors[c].blocks[b + 1][0], c, b + 1, 0))
            else:
                heapq.heappop(heap)
        place, score = places[0], gains[0]
        if len(places) > 1:
            place, score = np.concatenate(places), np.concatenate(gains)
            order = np.argsort(place, kind="stable")
            place, score = place[order], score[order]
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            place, score = place[first], np.add.reduceat(score, first)
        # A later document must beat the least of the best; among a stretch only its own best can stay.
        able = np.flatnonzero(score > (best[0][0] if len(best) == top else 0))
        if len(able) > top:
            able = able[np.argsort(-score[able], kind="stable")[:top]]
        for i in able.tolist():
            entry = (int(score[i]), -int(place[i]))
            if len(best) < top:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return sorted(best, reverse=True)


def query_terms(queries: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(item, term)``: the distinct terms of each query."""
    key_type = queries.schema[key].dataType.simpleString()

    def read_terms(batches):
        for batch in slices(batches, "text"):
            term, row, _, _ = term_counts(*text_buffer(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), pa.array(term.view(np.int64))], ["item", "term"])

    ship(__name__, base.__name__, textbytes.__name__)
    return queries.select(F.col(key).alias("item"), F.col(text).alias("text")).mapInArrow(read_terms, f"item {key_type}, term bigint").distinct()


def search_index(index: DataFrame, terms: DataFrame, top: int = TOP) -> DataFrame:
    """``(item, rank, key, score)`` from a stored ``index`` and ``terms(item, term)``."""
    shape = index.filter(F.col("term") == _DOCUMENTS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    n_docs, all_terms = shape["n"], shape["total"]
    blocks = max(1, math.ceil(terms.count() / QUERY_TERMS))
    asked = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    key_type, item_type = index.schema["keys"].dataType.elementType.simpleString(), terms.schema["item"].dataType.simpleString()
    postings = index.filter(F.col("term") != _DOCUMENTS)
    known = postings.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long").alias("weight")
    listed = cut(asked.groupBy("block", "term").agg(F.collect_list(F.struct("item")).alias("items")).join(known, "term").select("term", "block", weight, "items"))
    weighed = postings.join(F.broadcast(listed) if terms.count() <= BROADCAST_TERMS else listed, "term")
    columns = ["shard", "block", "term", "n", "first", "last", "places", "counts"]
    each = index.filter(F.col("term") == _DOCUMENTS).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = weighed.select(*columns, F.lit(None).cast(f"array<{key_type}>").alias("keys"), "weight", "items").unionByName(each.select(*columns, "keys", F.lit(0).cast("long").alias("weight"), F.lit(None).cast(f"array<struct<item:{item_type}>>").alias("items")))

    def rank(table: pa.Table) -> pa.Table:
        table = table.sort_by([("term", "ascending"), ("first", "ascending")])
        columns = {name: table.column(name).to_pylist() for name in ("term", "first", "last", "places", "counts", "weight", "items")}
        own = columns["term"].index(_DOCUMENTS)
        length = unpacked(columns["places"][own])
        norm = 10 + (90 * length * n_docs) // all_terms
        cursors: dict[int, Cursor] = {}
        of: dict[object, list[Cursor]] = {}
        for i, term in enumerate(columns["term"]):
            if i == own:
                continue
            if term not in cursors:
                cursors[term] = Cursor(columns["weight"][i], norm)
                for asking in columns["items"][i]:
                    of.setdefault(asking["item"], []).append(cursors[term])
            cursors[term].blocks.append((columns["first"][i], columns["last"][i], columns["places"][i], columns["counts"][i]))
        found = [(item, -place, score) for item, terms in of.items() for score, place in merged(terms, top)]
        keys = table.column("keys").combine_chunks()
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        kept = keys.slice(own, 1).flatten().take(pa.array([x[1] for x in found], pa.int64()))
        types = table.schema.field("items").type.value_type.field(0).type
        return pa.table({"item": pa.array([x[0] for x in found], types), "key": kept, "score": pa.array([x[2] for x in found], pa.int64())})

    ship(__name__, base.__name__, textbytes.__name__)
    local = rows.groupBy("shard", "block").applyInArrow(rank, f"item {item_type}, key {key_type}, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item", "rank", "key", "score")


def search(docs: DataFrame, queries: DataFrame, key: str, query: str, text: str = "text", query_text: str = "text", top: int = TOP) -> DataFrame:
    """``(item, rank, key, score)``: the ``top`` documents of each query.  The index made for it holds the queries' terms alone."""
    terms = cut(query_terms(queries, query, query_text))
    different = terms.select("term").distinct()
    only = np.sort(different.toArrow().column("term").to_numpy().view(np.uint64)) if different.count() <= BROADCAST_TERMS else None
    return search_index(stored(build_index(docs, key, text, only)), terms, top)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"), "doc_id", "item_id")
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT rid, doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*)::BIGINT AS nd, coalesce(sum(n), 1)::BIGINT AS l FROM e),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
p AS (SELECT rid, w, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS w FROM e) WHERE w IN (SELECT w FROM q) GROUP BY rid, w),
f AS (SELECT w, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT w, count(*) AS df FROM p GROUP BY w), s),
x AS (SELECT item_id, rid, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score FROM q JOIN p USING (w) JOIN f USING (w) JOIN e USING (rid), s GROUP BY item_id, rid),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x JOIN e USING (rid) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLES = {"op13_ranked_search": ORACLE}
