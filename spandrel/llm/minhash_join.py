"""Near-duplicate detection by a multi-index Hamming join over MinHash signatures.

Every document's set of word shingles gets a signature of SLOTS 16-bit values.
Two documents differ in a slot with a probability of one less their similarity.
The signature is split into chunks; of two signatures that differ in fewer than
``(ERRORS + 1) * CHUNKS`` slots, some chunk differs in at most ERRORS, so a key for
each chunk and each choice of ERRORS slots to leave out meets for every such pair
(pigeonhole).  With 10 chunks of 6 slots and one error, a pair of similarity 0.85
meets with a probability of 1 - 3e-7, whatever the size of the corpus.

Candidates are confirmed on full sets, as follows.
1. Documents with equal sets are one class, of which one is compared.
2. Keys shared by up to SMALL classes give their pairs, and those whose signatures
   differ in more than FAR slots are let go (a pair of similarity 0.85 does so once
   in 10^8).  Keys shared by more link all their classes to the smallest.
   Components of these candidate links are regions; every candidate pair lies within one.
3. A region is dealt into blocks of bounded size.  In a region of several blocks each
   set is first compared with that of its smallest document: those linked to it are
   linked with each other already, so only pairs of which one is not are left, and a
   region of copies of one text takes no more than one comparison each.  For each pair
   of blocks that is left one task gets the full sets, computes exact similarities of
   all its pairs at once as a matrix product, and returns a spanning forest of the
   links, so that no task holds a region and no pair is written out that links nothing
   new.
4. Components of the links are the groups.

Edge cases: a null or empty text has an empty set and is linked with nothing;
fewer words than a shingle make the whole sequence the one shingle; a row with a
null key gets no component; rows that share a key are one document as to links;
an empty table gives an empty result; extra columns are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, textbytes
from .base import any_key, cut, read, ship, slices, stored, text_buffer, without
from .components import by_value, components

CHUNKS, CHUNK, ERRORS = 10, 6, 1
SLOTS = CHUNKS * CHUNK
FAR = 26
SMALL = 16
BLOCK_ROWS, BLOCK_SHINGLES = 128, 200_000
_COLUMNS = 4096
#: Regions of several blocks whose sizes are sent to every executor at most; more are joined by a shuffle.
BROADCAST_REGIONS = 500_000
_draw = np.random.Generator(np.random.PCG64(0xB17))
_MULTIPLY = _draw.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 2**63, SLOTS, dtype=np.uint64)


def shingle_sets(batch: pa.RecordBatch, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of each row, sorted within the row, and the offsets of the rows."""
    raw, offsets = text_buffer(batch.column(text))
    prints, at = textbytes.prints(raw, offsets)
    n_words = np.diff(at)
    count = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + at[doc]
    grams = textbytes.grams(prints, k)[place] if len(prints) else np.zeros(0, np.uint64)
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        grams[np.searchsorted(doc, d)] = textbytes.mix(textbytes.grams(prints[at[d] : at[d + 1]], int(n_words[d]))[:1] + np.uint64(n_words[d]))[0]
    order = np.argsort(grams)
    order = order[np.argsort(doc[order], kind="stable")]
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.searchsorted(doc[new], np.arange(len(count) + 1))


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SLOTS 16-bit values a row; rows with an empty set have zeros."""
    out = np.zeros((len(at) - 1, SLOTS), np.uint16)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for i in range(SLOTS):
            least = np.minimum.reduceat(sets * _MULTIPLY[i] + _ADD[i], at[full])
            out[full, i] = textbytes.mix(least) & np.uint64(0xFFFF)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """For each row, a key for every chunk and slot of it that is left out."""
    keys = []
    for c in range(CHUNKS):
        part = signature[:, c * CHUNK : (c + 1) * CHUNK].astype(np.uint64)
        for skip in range(CHUNK):
            h = np.full(len(part), c * CHUNK + skip + 1, np.uint64)
            for j in range(CHUNK):
                if j != skip:
                    h = textbytes.mix(h * np.uint64(0x9FB21C651E98DF25) + part[:, j])
            keys.append(h)
    return np.stack(keys, 1).view(np.int64)


def sketch(docs: DataFrame, key: str, text: str = "text", k: int = 3) -> DataFrame:
    """``(key, n_shingles, f1, f2, signature, keys)``; f1 and f2 tell different sets apart."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, text):
            sets, at = shingle_sets(batch, text, k)
            n = np.diff(at)
            signature = signatures(sets, at)
            total = lambda x: np.where(n > 0, np.add.reduceat(np.append(x, np.uint64(0)), at[:-1]), np.uint64(0)).view(np.int64)
            keys = chunk_keys(signature)
            yield pa.RecordBatch.from_arrays([
                batch.column(key), pa.array(n), pa.array(total(textbytes.mix(sets))), pa.array(total(textbytes.mix(sets ^ np.uint64(0x51ED270B9F2C3A55)))),
                pa.array([row.tobytes() for row in signature], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())),
            ], [key, "n_shingles", "f1", "f2", "signature", "keys"])

    ship(__name__, base.__name__, textbytes.__name__)
    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, n_shingles bigint, f1 bigint, f2 bigint, signature binary, keys array<bigint>")


def _near(pairs: DataFrame) -> DataFrame:
    """Pairs ``(u, v, a, b)`` whose signatures a and b differ in at most FAR slots."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in "ab")
                yield batch.select(["u", "v"]).filter(pa.array((a != b).sum(1) <= FAR))

    ship(__name__, base.__name__, textbytes.__name__)
    types = dict(pairs.dtypes)
    return pairs.mapInArrow(run, f"u {types['u']}, v {types['v']}")


def candidate_links(reps: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between class representatives ``(id, signature, keys)``; all candidate pairs lie within their components."""
    wide = reps.select("id", F.explode("keys").alias("key"))
    shared = cut(wide.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1"))
    members = cut(by_value(wide, shared, "key", "n").select("key", "id", "n", "first"))
    stars = members.filter((F.col("n") > SMALL) & (F.col("id") != F.col("first"))).select(F.col("first").alias("u"), F.col("id").alias("v")).distinct()
    lists = members.filter(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("ids").distinct()
    place = F.posexplode("ids").alias("i", "u")
    pairs = lists.select("ids", place).select("u", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("v")).distinct()
    signed = pairs.join(reps.select(F.col("id").alias("u"), F.col("signature").alias("a")), "u").join(reps.select(F.col("id").alias("v"), F.col("signature").alias("b")), "v")
    return stars.union(_near(signed.select("u", "v", "a", "b")))


def block_links(sets: list[np.ndarray], side: np.ndarray, cross: bool, share: int, root: list[int]) -> list[tuple[int, int]]:
    """Links that join parts of ``root`` (a union-find forest, changed) among all pairs, or only those across the two sides."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), size)
    # Only shingles that occur twice can be in an intersection.
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    again = count > 1
    column = (np.cumsum(again) - 1)[number]
    keep = again[number]
    column, doc = column[keep], doc[keep]
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if cross else (np.arange(len(sets)),) * 2
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, z = np.searchsorted(column, [at, at + _COLUMNS])
        dense = np.zeros((len(sets), _COLUMNS), np.float32)
        dense[doc[a:z], column[a:z] - at] = 1
        both += dense[left] @ dense[right].T
    union = size[left][:, None] + size[right][None, :] - both
    found = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in zip(*np.nonzero(100 * both.astype(np.int64) >= share * union.astype(np.int64)), strict=True):
        x, y = int(left[i]), int(right[j])
        if x != y and (a := find(x)) != (b := find(y)):
            root[a] = b
            found.append((x, y))
    return found


def _linked_to_first(sets: DataFrame, share: int) -> DataFrame:
    """``sets(id, region, blocks, block, shingles)`` with ``near``: whether a set is linked to the one of its region's smallest document."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sets.schema)
    names = sets.columns
    first = sets.filter("id = region").groupBy("region", "blocks").agg(F.min("shingles").alias("first"))
    # One copy of that set for each block, so that a region's rows need not meet.
    copies = first.select("region", "first", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def compare(batches):
        for batch in batches:
            near = []
            for own, other in zip(batch.column("shingles").to_pylist(), batch.column("first").to_pylist(), strict=True):
                a, b = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(100 * both >= share * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(near, pa.bool_())], [*names, "near"])

    ship(__name__, base.__name__, textbytes.__name__)
    return sets.join(copies, ["region", "block"]).select(*names, "first").mapInArrow(compare, f"{types}, near boolean")


def _blocks(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def confirmed_links(docs: DataFrame, regions: DataFrame, key: str, text: str, k: int, share: int) -> DataFrame:
    """Links ``(u, v)`` of similarity ``share`` percent or more that span each region.

    ``regions``: ``(id, region, n_shingles)``, the region named by its smallest id; ``docs`` must hold one row an id at least.
    """
    shape = regions.groupBy("region").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("blocks"))
    block = lambda n: F.pmod(F.xxhash64(F.lit(3), "id"), n).cast("int")
    dealt = cut(regions.join(shape, "region").select("id", "region", "blocks", block(F.col("blocks")).alias("block")))
    id_type = dict(regions.dtypes)["id"]

    def to_sets(batches):
        for batch in slices(batches, "text"):
            sets, at = shingle_sets(batch, "text", k)
            values = pa.array([sets[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "region", "blocks", "block")), values], ["id", "region", "blocks", "block", "shingles"])

    def sets_of(places: DataFrame) -> DataFrame:
        owned = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(places, "id").select("id", "region", "blocks", "block", "text")
        return owned.mapInArrow(to_sets, f"id {id_type}, region {id_type}, blocks int, block int, shingles binary")

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("shingles", "ascending")])
        ids, values = table.column("id").to_pylist(), table.column("shingles").to_pylist()
        first = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1] or values[i] != values[i - 1]]
        ids = [ids[i] for i in first]
        # Rows that share an id are one document, joined from the start, with all of its different sets.
        root = [*range(len(ids))]
        for i in range(1, len(ids)):
            if ids[i] == ids[i - 1]:
                root[i] = root[i - 1]
        sets = [np.frombuffer(values[i], np.uint64) for i in first]
        block = table.column("block").to_numpy()[first]
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        links = block_links(sets, block == q, p != q, share, root) if len(ids) > 1 else []
        return pa.table({"u": pa.array([ids[a] for a, _ in links], table.schema.field("id").type), "v": pa.array([ids[b] for _, b in links], table.schema.field("id").type)})

    ship(__name__, base.__name__, textbytes.__name__)
    schema = f"u {id_type}, v {id_type}"
    links = sets_of(dealt.filter("blocks = 1")).select("id", "region", "block", "shingles", F.lit(0).alias("p"), F.lit(0).alias("q")).groupBy("region", "p", "q").applyInArrow(link, schema)
    several = dealt.filter("blocks > 1")
    if several.isEmpty():
        return links
    compared = stored(_linked_to_first(sets_of(several), share))
    near = compared.filter(F.col("near") & (F.col("id") != F.col("region"))).select(F.col("region").alias("u"), F.col("id").alias("v")).distinct()
    # Blocks of the sets that are not linked come first; pairs of two blocks of linked ones are left out.
    weight = F.octet_length("shingles") / 8
    of = lambda x: _blocks(F.sum(F.when(x, 1).otherwise(0)), F.sum(F.when(x, weight).otherwise(0)))
    sizes = compared.groupBy("region").agg(of(~F.col("near")).alias("apart"), of(F.col("near")).alias("linked")).filter("apart > 0")
    placed = compared.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_REGIONS else sizes, "region")
    placed = placed.withColumn("block", F.when(F.col("near"), F.col("apart") + block(F.greatest("linked", F.lit(1)))).otherwise(block(F.col("apart"))))
    others = F.sequence(F.lit(0), F.when(F.col("near"), F.col("apart") - 1).otherwise(F.col("apart") + F.col("linked") - 1))
    paired = placed.withColumn("other", F.explode(others)).select("id", "region", "block", "shingles", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    return links.union(near).union(paired.groupBy("region", "p", "q").applyInArrow(link, schema))


@any_key("n_shingles", "component_id")
def near_duplicates(docs: DataFrame, key: str, text: str = "text", k: int = 3, share: int = 85) -> DataFrame:
    """Per row of ``docs``: ``key``, ``n_shingles`` and ``component_id``, the smallest key of its group.  ``share``: percent of similarity that links."""
    drawn = cut(sketch(docs, key, text, k))
    classes = drawn.filter((F.col("n_shingles") > 0) & F.col(key).isNotNull()).groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct(F.col(key).alias("id"), "signature", "keys")).alias("rep"))
    reps = cut(classes.select("f1", "f2", "n_shingles", "rep.*"))
    # A document may have rows of different texts; a class is then represented by all it has.
    regions = components(candidate_links(reps.select("id", "signature", "keys")))
    regions = regions.select("id", F.col("component").alias("region")).join(reps.groupBy("id").agg(F.sum("n_shingles").alias("n_shingles")), "id")
    links = components(confirmed_links(docs, regions, key, text, k, share))
    grouped = reps.select("f1", "f2", F.col("n_shingles").alias("_n"), "id").join(links, "id", "left").select("f1", "f2", "_n", F.coalesce("component", "id").alias("component_id"))
    joined = drawn.select(key, "n_shingles", "f1", "f2").join(grouped, (drawn["f1"] == grouped["f1"]) & (drawn["f2"] == grouped["f2"]) & (drawn["n_shingles"] == grouped["_n"]), "left")
    return joined.select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.coalesce("component_id", F.col(key))).alias("component_id"))


@any_key()
def drop_near_duplicates(docs: DataFrame, key: str, text: str = "text", k: int = 5, share: int = 80) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest key; of rows that share its key, one.  Rows with a null key stay."""
    found = cut(near_duplicates(docs, key, text, k, share))
    kept = without(docs, found.filter(F.col("component_id") != F.col(key)).select(key).distinct(), key)
    several = cut(found.filter(F.col("component_id") == F.col(key)).groupBy(key).count().filter("count > 1").select(key))
    if several.isEmpty():
        return kept
    return without(kept, several, key).union(kept.join(several, key, "left_semi").dropDuplicates([key]))


def op6_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


QUERIES = {"op6_minhash_join": op6_minhash_join}
ORACLES: dict[str, str] = {}
