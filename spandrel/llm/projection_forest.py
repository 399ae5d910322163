"""Near-duplicate vectors by a forest of random-projection trees with spill.

A tree splits space again and again: each level has a random direction, and each node
the median of its part of a bounded sample along it.  Rows within ``spill`` of a
threshold go to both sides, so that close pairs seldom part.  The leaves of all trees
are dealt as groups; within a leaf all pairs are compared, in double precision, and
what reaches the threshold is a link.  The links' ends are united by connected
components.

Equal vectors are one class from the start.  The vectors of a leaf with more than
``BLOCK`` rows are compared in pairs of blocks, each a task's group, so that dense
regions are spread and nothing is cut.  No pair leaves a task: a pair of vectors counts in
the first leaf that they share, which each can tell as vectors carry the numbers of their
leaves; a leaf returns a number of links for each vector and a spanning forest of its
links.

The sample (``SAMPLE`` vectors by hash) fixes thresholds only; every vector is indexed.
Below the levels that the sample can fill, thresholds are medians of the sample's
lowest filled cells along the further directions, so a model's size is bounded while
its depth grows with the logarithm of the rows.

The recall falls with depth and with the angle; see the README.

Edge cases: a vector that is null, of length zero, or has null or non-finite
components links with nothing, as do rows without an id; vectors of different sizes
are compared within their size; repeated rows are links of each other; rows that share
an id with different vectors are counted each for itself and united by the id; an empty
table gives an empty result; extra columns are never touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .base import cut, read, ship, stored
from .components import by_value, components

LEAST_COSINE = 0.9
TREES = 8
#: Rows that a leaf should hold, rows that are compared by one task, vectors that fix the thresholds at most (in expectation).
LEAF, BLOCK, SAMPLE = 384, 2048, 32_768
#: Distance from a threshold, of unit vectors' projections, within which a vector goes to both sides, times the square root of the dimensions.
SPILL = 0.16
#: Sample rows that a cell keeps for its median.
_LEAST_SAMPLE = 32
#: Leaves in blocks that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_LEAVES = 200_000
_ROWS = 4096
_TREE = 48


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision whatever their magnitude."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Forest:
    """Directions and thresholds of all trees, for vectors of one size."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, leaf: int, spill: float, seed: int = 12):
        n, size = sample.shape
        self.depth = max(0, int(np.ceil(np.log2(max(rows, 1) / leaf))))
        self.top = max(0, min(self.depth, int(np.log2(max(n / _LEAST_SAMPLE, 1)))))
        self.spill = spill / np.sqrt(size)
        self.directions, self.thresholds, self.deep = [], [], []
        draw = np.random.Generator(np.random.PCG64(seed))
        for _ in range(trees):
            bank = draw.normal(size=(size, self.depth))
            bank /= np.sqrt((bank * bank).sum(axis=0))
            shown = sample @ bank
            node = np.zeros(n, np.int64)
            levels = []
            for level in range(self.top):
                medians = _medians(node, shown[:, level], 1 << level)
                levels.append(medians)
                node = 2 * node + (shown[:, level] >= medians[node])
            self.directions.append(bank)
            self.thresholds.append(levels)
            self.deep.append([_medians(node, shown[:, level], 1 << self.top) for level in range(self.top, self.depth)])

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers of the leaves that hold them, sorted by both; numbers of later trees are larger."""
        rows, leaves = [], []
        for t, bank in enumerate(self.directions):
            shown = vectors @ bank
            row, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
            for level in range(self.depth):
                at = self.thresholds[t][level][node] if level < self.top else self.deep[t][level - self.top][node >> (level - self.top)]
                value = shown[row, level]
                left, right = value < at + self.spill, value >= at - self.spill
                row = np.concatenate([row[left], row[right]])
                node = np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            leaves.append(node + (t << _TREE))
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def _medians(node: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Median of the values at each of ``n`` nodes; 0 for a node without any."""
    order = np.lexsort((value, node))
    ends = np.searchsorted(node[order], np.arange(n + 1))
    out = np.zeros(n)
    full = ends[1:] > ends[:-1]
    out[full] = value[order][((ends[1:] + ends[:-1]) // 2)[full]]
    return out


def _first_shared(own: np.ndarray, other: np.ndarray, leaf: int, trees: int) -> np.ndarray:
    """Whether no leaf before ``leaf`` is shared by the two rows of leaf numbers, padded with distinct negative ones, of each pair."""
    fresh = np.ones(len(own), bool)
    for a in range(own.shape[1]):
        if not (own[:, a] < leaf).any():
            break
        alive = np.flatnonzero(fresh & (own[:, a] >= 0) & (own[:, a] < leaf))
        if len(alive):
            fresh[alive] &= ~(other[alive] == own[alive, a][:, None]).any(axis=1)
    return fresh


def leaf_links(vectors: np.ndarray, ids: list, copies: np.ndarray, leaves: list[np.ndarray], leaf: int, side: np.ndarray, cross: bool, least: float, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the copies that it links with for the first time here, and the row that stands for its part of these links.

    ``cross``: compare only rows of different ``side``.
    """
    n = len(vectors)
    width = max(map(len, leaves))
    own, other = np.full((n, width), -1, np.int64), np.full((n, width), -2, np.int64)
    for i, x in enumerate(leaves):
        own[i, : len(x)] = other[i, : len(x)] = x
    links, root = np.zeros(n, np.int64), [*range(n)]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    lefts, rights = (np.flatnonzero(~side), np.flatnonzero(side)) if cross else (np.arange(n), np.arange(n))
    for at in range(0, len(lefts), 256):
        some = lefts[at : at + 256]
        near = vectors[some] @ vectors[rights].T >= least
        if not cross:
            near &= rights[None, :] > some[:, None]
        i, j = np.nonzero(near)
        for start in range(0, len(i), 65_536):
            u, v = some[i[start : start + 65_536]], rights[j[start : start + 65_536]]
            first = _first_shared(own[u], other[v], leaf, trees)
            u, v = u[first], v[first]
            links += np.bincount(u, weights=copies[v], minlength=n).astype(np.int64) + np.bincount(v, weights=copies[u], minlength=n).astype(np.int64)
            # Pairs whose ends stand for themselves already in the same part are most; only the others are walked.
            while len(u):
                known = np.array(root)
                u, v = u[known[u] != known[v]], v[known[u] != known[v]]
                for x, y in zip(u[:256].tolist(), v[:256].tolist(), strict=True):
                    a, b = find(x), find(y)
                    if a != b:
                        a, b = (a, b) if ids[a] <= ids[b] else (b, a)
                        root[b] = a
                u, v = u[256:], v[256:]
                for x in range(n):
                    root[x] = find(x)
    return links, np.array(root)


def _prepared(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """``(id, size, vector, h1, h2)``: the components as bytes, null where they link with nothing."""
    element = vectors.schema[embedding].dataType.elementType.simpleString()
    wide = element != "float"
    good = F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col(key).alias("id"), F.col(embedding).cast(f"array<{'double' if wide else 'float'}>").alias("x"))
    rows = rows.select("id", F.when(good & F.col("id").isNotNull(), F.col("x")).alias("x"))

    def pack(batches):
        for batch in batches:
            x = batch.column("x")
            kind = np.float64 if wide else np.float32
            values = [None if v is None else np.array(v, kind).tobytes() for v in x.to_pylist()] if x.null_count else _even(x, kind)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values, pa.binary())], ["id", "vector"])

    ship(__name__, base.__name__)
    id_type = vectors.schema[key].dataType.simpleString()
    packed = rows.mapInArrow(pack, f"id {id_type}, vector binary")
    return packed.select("id", "vector", (F.octet_length("vector") / (8 if wide else 4)).cast("int").alias("size"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))


def _even(x: pa.Array, kind: type) -> list[bytes]:
    ends = x.offsets.to_numpy()
    flat = x.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return [flat[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]


def _linked(classes: DataFrame, size: int, rows: int, kind: type, least: float, trees: int, leaf: int, block: int, sample: int, spill: float) -> DataFrame:
    """``(id, h1, h2, links, root)`` of the classes of one vector size, once for each leaf that finds links of theirs."""
    share = min(1.0, sample / max(rows, 1))
    drawn = classes.filter(F.pmod(F.xxhash64(F.lit(2), "h1"), F.lit(1 << 32)) < F.lit(int(share * (1 << 32)))).select("vector").orderBy("vector").toArrow()
    known = np.frombuffer(b"".join(drawn.column("vector").to_pylist()), kind).reshape(-1, size)
    forest = Forest(unit(known) if len(known) else np.zeros((0, size)), rows, trees, leaf, spill)
    id_type = dict(classes.dtypes)["id"]

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                vectors = np.frombuffer(b"".join(part.column("vector").to_pylist()), kind).reshape(-1, size)
                row, found = forest.leaves(unit(vectors))
                ends = np.searchsorted(row, np.arange(len(vectors) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "h1", "h2", "n", "vector")), lists], ["id", "h1", "h2", "n", "vector", "leaves"])

    ship(__name__, base.__name__)
    routed = stored(classes.select("id", "h1", "h2", "n", "vector").mapInArrow(route, f"id {id_type}, h1 bigint, h2 bigint, n bigint, vector binary, leaves array<bigint>"))
    members = routed.select("*", F.explode("leaves").alias("leaf"))
    sizes = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    several = cut(sizes.filter("blocks > 1"))
    n_several = several.count()
    zero = F.lit(0)
    paired = members.withColumns({"p": zero, "q": zero, "block": zero})
    if n_several:
        joined = members.join(F.broadcast(several) if n_several <= BROADCAST_LEAVES else several, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        joined = joined.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "h1", "h2"), F.col("blocks")).cast("int"))
        each = joined.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        paired = each.select(*members.columns, F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block")

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        vectors = unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(-1, size))
        lists = table.column("leaves").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        links, root = leaf_links(vectors, ids, table.column("n").to_numpy(), [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)], table.column("leaf")[0].as_py(), table.column("block").to_numpy() == q, p != q, least, trees)
        hit = np.flatnonzero(links)
        own = table.select(["id", "h1", "h2"]).take(pa.array(hit))
        return own.append_column("links", pa.array(links[hit])).append_column("root", table.column("id").take(pa.array(root[hit])))

    return paired.groupBy("leaf", "p", "q").applyInArrow(compare, f"id {id_type}, h1 bigint, h2 bigint, links bigint, root {id_type}")


def near_duplicates(vectors: DataFrame, key: str, embedding: str = "embedding", least: float = LEAST_COSINE, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE, spill: float = SPILL) -> DataFrame:
    """Per row of ``vectors``: ``id``, ``n_links`` and ``component_id``, the smallest id reachable by links of cosine ``least`` or more."""
    kind = np.float32 if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else np.float64
    rows = stored(_prepared(vectors, key, embedding))
    classes = stored(rows.filter("vector IS NOT NULL").groupBy("h1", "h2", "size").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector")))
    found = None
    for shape in classes.groupBy("size").count().filter("count > 1").orderBy("size").toLocalIterator():
        part = _linked(classes.filter(F.col("size") == shape["size"]), shape["size"], shape["count"], kind, least, trees, leaf, block, sample, spill)
        found = part if found is None else found.unionByName(part)
    answer = classes.select("h1", "h2", "id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("links"))
    if found is not None:
        found = stored(found)
        roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
        links = found.groupBy("id", "h1", "h2").agg(F.sum("links").alias("links"))
        several = answer.select("h1", "h2", "id", "n").join(links, ["id", "h1", "h2"], "left").join(roots, "id", "left")
        answer = several.select("h1", "h2", "id", "n", F.coalesce("component", "id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    answer = stored(answer.withColumn("n_links", F.col("n") - 1 + F.col("links")))
    result = ["id", "n_links", "component_id"]
    # A class of one vector is its row; rows of the others look up their class, hot ones where they are.
    copies = answer.filter("n > 1").select(F.struct("h1", "h2").alias("class"), "n", "n_links", "component_id")
    alone = answer.filter("n = 1").select(*result)
    out = alone.unionByName(rows.filter("vector IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    if copies.isEmpty():
        return out
    return out.unionByName(by_value(rows.filter("vector IS NOT NULL").select("id", F.struct("h1", "h2").alias("class")), cut(copies), "class", "n").select(*result))


def drop_near_duplicates(vectors: DataFrame, key: str, **settings) -> DataFrame:
    """``vectors`` without rows that are linked, by whatever path, with a row of a smaller key."""
    found = near_duplicates(vectors, key, **settings)
    return base.without(vectors, found.filter(F.col("component_id") < F.col("id")).select(F.col("id").alias(key)).distinct(), key)


def op12_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


QUERIES = {"op12_projection_forest": op12_projection_forest}
#: Links are those that the forest finds; tests hold them against brute force.
ORACLES: dict[str, str] = {}
