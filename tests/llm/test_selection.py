"""Importance resampling, near-duplicate vectors and ranked search against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def texts(n, seed, vocabulary=60):
    draw = random.Random(seed)
    own = ["".join(draw.choice("abcdeéñ0") for _ in range(draw.randint(1, 7))) for _ in range(vocabulary)] + ["x" * 70, "y" * 200]
    return [draw.choice([" ", "", "-"]) + "".join(draw.choice(own).title() + draw.choice([" ", ", ", "\n", "--"]) for _ in range(draw.randint(0, 60))) for _ in range(n)]


# -- operator 11


def resampled(rows, target, buckets, runs, percent, least, seed):
    def features(text):
        w = words(text)
        return [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in rows for f in features(t))
    t = collections.Counter(bucket(f) for x in target for f in features(x))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out = []
    for key, text in rows:
        f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // max(len(f), 1)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[1], x[2], x[3]))
    drawn = [[*x, i + 1] for i, x in enumerate(fit[: percent * len(fit) // 100])]
    return collections.Counter(map(tuple, drawn)) + collections.Counter((*x, None) for x in fit[len(drawn) :]) + collections.Counter((*x, None) for x in out if x[1] < least)


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_resampling_is_that_of_brute_force(spark, runs):
    from spandrel.llm import importance_resampling as op

    rows = [*enumerate(texts(120, 1)), (7, None), (8, ""), (None, "one two three four five six"), *[(5, "same text again and again")] * 9]
    target = [*texts(9, 2, 30), None, ""]
    docs, items = spark.createDataFrame(rows, "score int, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string")
    found = op.scores(docs, items, "score", buckets=97, runs=runs, percent=40, least_words=4, seed="s")
    assert found.columns == ["key", "n_words", "n_features", "weight", "score", "rank"]
    assert collections.Counter(map(tuple, found.collect())) == resampled(rows, target, 97, runs, 40, 4, "s")


def test_resampling_of_long_texts_and_empty_tables(spark):
    from spandrel.llm import importance_resampling as op

    long = "Alpha, beta " * 400_000 + "z" * 5_000_000
    rows, target = [(1, long), (2, "alpha")], ["beta"]
    docs, items = spark.createDataFrame(rows, "k long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    assert collections.Counter(map(tuple, op.scores(docs, items, "k", buckets=10, percent=100, least_words=1, seed="s").collect())) == resampled(rows, target, 10, 1, 100, 1, "s")
    assert op.scores(docs.limit(0), items, "k").collect() == []
    assert {r["rank"] for r in op.scores(docs, items.limit(0), "k", percent=0).collect()} == {None}


def test_resampled_rows_are_whole(spark):
    from spandrel.llm import importance_resampling as op

    docs = spark.createDataFrame([(i, t, i, -1) for i, t in enumerate(texts(60, 3))], "id int, body string, key int, rank int")
    items = spark.createDataFrame([(t,) for t in texts(5, 4)], "text string")
    out = op.resample(docs, items, "id", text="body", percent=50, least_words=1)
    n = docs.filter(F.length(F.regexp_replace("body", r"[\s,-]", "")) > 0).count()
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, n // 2 + 1))
    assert set(out.columns) == {"id", "body", "key", "rank"}
    assert op.resample(docs.select("rank", "body").withColumn("rank", F.monotonically_increasing_id()), items, "rank", text="body", percent=50, least_words=1).count() == n // 2


# -- operator 12


def brute_links(rows, least):
    good = [(i, k, np.array(v, float) / np.abs(v).max()) for i, (k, v) in enumerate(rows) if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, root = collections.Counter(), {k: k for k, _ in rows}
    edges = [(a, b) for a, k, x in good for b, m, y in good if a < b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least]
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[rows[a][0]], root[rows[b][0]])
            for k in (rows[a][0], rows[b][0]):
                if root[k] != m:
                    root[k], changed = m, True
    return collections.Counter((k, links[i], root[k]) for i, (k, _) in enumerate(rows))


def neighbours(n, size, cosine, seed):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = draw.normal(size=(n, size))
    y -= (y * x).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    return x, cosine * x + math.sqrt(1 - cosine**2) * y


def test_vector_links_are_those_of_brute_force(spark):
    from spandrel.llm import projection_forest as op

    draw = np.random.default_rng(5)
    x, y = neighbours(150, 16, 0.93, 6)
    dense = x[0] + 0.03 * draw.normal(size=(120, 16))
    vectors = [*x.tolist(), *(3 * y).tolist(), *dense.tolist(), *[x[3].tolist()] * 20, *(1e200 * x[5:7]).tolist()]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(901, None), (902, []), (903, [0.0] * 16), (904, [1.0] * 15 + [None]), (905, [1.0] * 15 + [float("nan")]), (906, [float("inf")] * 16), (None, x[0].tolist()), (907, [1.0, 2.0]), (908, [2.0, 4.1]), (3, x[9].tolist())]
    table = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "n int, embedding array<double>, id int, links int").repartition(3)
    expected = brute_links(rows, 0.9)
    for settings in ({"leaf": 500}, {"leaf": 24, "block": 16, "trees": 12, "spill": 0.5}, {"leaf": 24, "block": 50, "trees": 12, "spill": 0.5, "sample": 40}):
        assert collections.Counter(map(tuple, op.near_duplicates(table, "n", **settings).collect())) == expected, settings
    kept = op.drop_near_duplicates(table, "n")
    assert kept.columns == table.columns
    assert {r["n"] for r in kept.collect()} == {k for k, _, c in expected if k == c}


def test_empty_vectors(spark):
    from spandrel.llm import projection_forest as op

    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op.near_duplicates(empty, "vec_id").collect() == []
    assert op.near_duplicates(spark.createDataFrame([(1, None)], empty.schema), "vec_id").collect() == [(1, 0, 1)]


@pytest.mark.parametrize(("cosine", "least"), [(0.901, 0.98), (0.95, 0.995), (0.99, 0.999)])
def test_forest_recall_by_angle(cosine, least):
    """Leaves shared by pairs at a fixed angle among 40,000 vectors, the default depth for that many."""
    from spandrel.llm import projection_forest as op

    x, y = neighbours(1500, 64, cosine, 8)
    rest = np.random.default_rng(9).normal(size=(37_000, 64))
    sample = np.concatenate([x, rest])[:: 2]
    forest = op.Forest(op.unit(sample), 40_000, op.TREES, op.LEAF, op.SPILL)
    leaves = [[set(found[row == i]) for i in range(len(v))] for v in (x, y) for row, found in [forest.leaves(op.unit(v))]]
    assert np.mean([bool(a & b) for a, b in zip(*leaves, strict=True)]) >= least


# -- operator 13


def ranking(rows, items, top):
    docs = [(key, collections.Counter(words(t)), len(words(t))) for key, t in rows if words(t)]
    n, total = len(docs), sum(x[2] for x in docs)
    df = collections.Counter(w for _, c, _ in docs for w in c)
    queries = collections.defaultdict(set)
    for item, text in items:
        queries[item] |= set(words(text))
    out = []
    for item, terms in queries.items():
        found = []
        for key, c, size in docs:
            m = 10 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms if w in c)
            if score > 0:
                found.append((-score, key is None, key or "", key))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def test_ranking_is_that_of_brute_force(spark, monkeypatch):
    from spandrel.llm import ranked_search as op

    draw = random.Random(11)
    rows = [(f"d{i % 250:03}", t) for i, t in enumerate(texts(400, 12))] + [(None, "abc abc"), ("e", None), ("f", "--"), *[("same", "ab cde")] * 30]
    items = [(i, " ".join(draw.sample(words(" ".join(texts(20, 12))), 12))) for i in range(12)] + [(1, "ab cde"), (50, None), (51, ""), (None, "ab abc"), (52, "neverseen")]
    docs, queries = spark.createDataFrame([(*r, 0) for r in rows], "shard string, text string, term int").repartition(4), spark.createDataFrame(items, "term int, text string")
    expected = ranking(rows, items, 7)
    assert sorted(map(tuple, op.search(docs, queries, "shard", "term", top=7).collect()), key=repr) == expected
    monkeypatch.setattr(op, "QUERY_TERMS", 30)
    monkeypatch.setattr(op, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, op.search(docs, queries, "shard", "term", top=7).collect()), key=repr) == expected
    monkeypatch.setattr(op, "BLOCK", 3)
    index = op.stored(op.build_index(docs, "shard", shard_documents=40))
    assert index.filter("term = 0").count() >= 4
    assert index.filter("term <> 0").agg(F.max("n")).first()[0] <= 16_384
    assert sorted(map(tuple, op.search_index(index, op.query_terms(queries, "term"), 7).collect()), key=repr) == expected
    assert op.search(docs.limit(0), queries, "shard", "term").collect() == []
    assert op.search(docs, queries.limit(0), "shard", "term").collect() == []


def test_merge_over_many_small_blocks(monkeypatch):
    from spandrel.llm import ranked_search as op

    draw = np.random.default_rng(13)
    norm = draw.integers(10, 400, 3000)
    cursors, dense = [], np.zeros(3000, np.int64)
    for t in range(9):
        place = np.sort(draw.choice(3000, int(draw.integers(1, 2500)), replace=False))
        count = draw.integers(1, 300, len(place))
        cursor = op.Cursor(int(draw.integers(0, 900)), norm)
        for at in range(0, len(place), 7):
            some, counts = place[at : at + 7], count[at : at + 7]
            cursor.blocks.append((int(some[0]), int(some[-1]), op.packed(np.diff(some, prepend=0))[0].tobytes(), op.packed(counts)[0].tobytes()))
        cursors.append(cursor)
        dense[place] += cursor.weight * (1_000_000_000 * count // (1000 * count + 8 * norm[place]))
    best = sorted(((int(s), -i) for i, s in enumerate(dense) if s > 0), reverse=True)
    assert op.merged(cursors, 25) == best[:25]


def test_numbers_are_packed_and_unpacked():
    from spandrel.llm import ranked_search as op

    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**31, 2**62 - 1, 5])
    assert (op.unpacked(op.packed(values)[0].tobytes()) == values).all()
    assert len(op.unpacked(b"")) == 0
