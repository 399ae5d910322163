"""Importance resampling of documents towards a target distribution, drawn without replacement by Gumbel noise.

Hashed features are counted over all raw and all target texts.  Each feature bucket
gets a whole-number gain, kept in an array of ``buckets`` entries; a document's weight
is the floored mean of its features' gains.  Weight and noise are whole numbers, so the
scores of all documents have a histogram that is exact and short: noise and gains lie
within some 2^16 different values, however many documents there are.  Its counts, summed
from the highest score down, tell how many documents rank before each score, and so the
cutoff score and the rank at which each score starts; only documents at or above the
cutoff are numbered, by their key, each score by itself.  No sort of all documents takes
place, and nothing but the gains and a few sums comes to the driver.

Words are maximal runs of ASCII letters, digits and non-ASCII characters with A-Z in lower case.
Features are all runs of 1 to ``runs`` consecutive words joined by one space.

Edge cases: a null or wordless text has no features, weight 0 and, below
``least_words``, no rank; a null key draws the noise of an empty key and comes after
all others of its score; repeated rows each count, and get consecutive ranks; empty
tables give an empty result (documents) or gains that speak of raw counts alone
(target); extra columns are never touched, and the key may have any name and any type
with an order.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base, textbytes
from .base import cut, read, replicated, ship, slices, stored, text_buffer

BUCKETS = 10_000
SEED = "2024"
PERCENT = 10
LEAST_WORDS = 20
#: Different scores whose ranks are sent to every executor at most; more are joined by a shuffle.
BROADCAST_SCORES = 200_000
#: Bytes of a word that are hashed for all words at once; the rest of longer ones goes word by word.
_SHORT = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Unsigned CRC-32 of each span of ``raw``, going on from the checks ``before``."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at, size = starts[order], length[order]
    state = (np.zeros(len(at), np.uint32) if before is None else before[order].astype(np.uint32)) ^ np.uint32(0xFFFFFFFF)
    live = np.searchsorted(-size, -np.arange(min(int(size[0]) if len(size) else 0, _SHORT)), side="left")
    for j, n in enumerate(live):
        state[:n] = _CRC[(state[:n] ^ raw[at[:n] + j]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-size, -_SHORT, side="left"))):
        state[i] = zlib.crc32(raw[at[i] + _SHORT : at[i] + size[i]], int(state[i]))
    out = np.empty(len(at), np.uint32)
    out[order] = state
    return out


def _stretches(raw: np.ndarray, offsets: np.ndarray, runs: int):
    """The rows of a slice; a single long row in parts that end between words, if features are single words."""
    size = textbytes.STRETCH
    if runs > 1 or len(offsets) > 2 or len(raw) <= 2 * size:
        yield raw, offsets
        return
    at = 0
    while at < len(raw):
        to = min(at + size, len(raw))
        while to < len(raw):
            found = np.flatnonzero(~textbytes._ALNUM[raw[to : to + 4096]])
            to = to + int(found[0]) if len(found) else min(to + 4096, len(raw))
            if len(found):
                break
        yield raw[at:to], np.array([0, to - at])
        at = to


def feature_buckets(raw: np.ndarray, offsets: np.ndarray, buckets: int, runs: int):
    """Yields ``(bucket, row, words)``: buckets of features with their rows, and the words of each row, for parts of the rows."""
    for part, own in _stretches(raw, offsets, runs):
        low = textbytes._FOLD[part]
        starts, ends, before = textbytes.spans(part, own, alnum=True)
        row = np.repeat(np.arange(len(own) - 1), np.diff(before))
        check = crc32(low, starts, ends)
        yield check % np.uint32(buckets), row, np.diff(before)
        for k in range(1, runs):
            # Runs that start so late that they would leave their row go.
            whole = np.flatnonzero(row[k:] == row[: len(row) - k]) if len(row) > k else np.zeros(0, np.int64)
            space = np.full(1, 32, np.uint8)
            check = check[:-1] if k > 1 else check
            longer = np.zeros(max(len(row) - k, 0), np.uint32)
            longer[whole] = crc32(space, np.zeros(len(whole), np.int64), np.ones(len(whole), np.int64), check[whole])
            longer[whole] = crc32(low, starts[whole + k], ends[whole + k], longer[whole])
            yield longer[whole] % np.uint32(buckets), row[whole], np.zeros(len(own) - 1, np.int64)
            check = np.concatenate([longer, np.zeros(1, np.uint32)])


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, runs: int = 1) -> DataFrame:
    """``(bucket, n)``: features of all texts by bucket; each task sums what it reads."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            for bucket, _, _ in feature_buckets(*text_buffer(batch.column("text")), buckets, runs):
                total += np.bincount(bucket, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    ship(__name__, base.__name__, textbytes.__name__)
    return docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Whole-number gain of each bucket, from two tables ``(bucket, n)``: ``buckets`` numbers whatever was counted."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, table in ((s, raw), (t, target)):
        found = table.toPandas()
        counts[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    all_s, all_t = float(int(s.sum()) + buckets), float(int(t.sum()) + buckets)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * all_s / ((float(x) + 1) * all_t))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, key: str, text: str = "text", runs: int = 1) -> DataFrame:
    """Per row of ``docs``: ``key``, ``n_words``, ``n_features`` and ``weight``, the floored mean gain of its features."""
    buckets = len(gain)

    def weigh(batches):
        for batch in slices(batches, "text"):
            raw, offsets = text_buffer(batch.column("text"))
            words, features, total = (np.zeros(len(offsets) - 1, np.int64) for _ in range(3))
            for bucket, row, n in feature_buckets(raw, offsets, buckets, runs):
                words += n
                features += np.bincount(row, minlength=len(words))
                sums = np.concatenate(([0], np.cumsum(gain[bucket])))
                ends = np.searchsorted(row, np.arange(len(words) + 1))
                total += sums[ends[1:]] - sums[ends[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, (words, features, total // np.maximum(features, 1)))], ["key", "n_words", "n_features", "weight"])

    ship(__name__, base.__name__, textbytes.__name__)
    key_type = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(weigh, f"key {key_type}, n_words bigint, n_features bigint, weight bigint")


def noise(key: Column, seed: str = SEED) -> Column:
    """Whole-number Gumbel noise that depends on ``seed`` and the key alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored(key, n_words, score, ...)`` with ``rank`` of the drawn rows, 1 for the highest score; the rest has null."""
    fit = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    histogram = cut(scored.filter(fit).groupBy("score").agg(F.count("*").alias("n")))
    shape = histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("scores")).first()
    draw = percent * shape["n"] // 100
    above = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(histogram.select("score", F.coalesce(above, F.lit(0)).alias("_before")).filter(F.col("_before") < draw))
    cutoff = starts.agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return scored.select("*", none)
    surviving = fit & (F.col("score") >= cutoff)
    # Equal rows are one until they are numbered, so that no key makes a score long.
    once = scored.filter(surviving).groupBy(*scored.columns).agg(F.count("*").alias("_n"))
    once = once.join(F.broadcast(starts) if shape["scores"] <= BROADCAST_SCORES else starts, "score")
    rest = [F.col(c) for c in scored.columns if c not in ("key", "score")]
    order = Window.partitionBy("score").orderBy(F.col("key").asc_nulls_last(), *rest)
    if once.filter("_n > 1").isEmpty():
        numbered = once.withColumn("rank", F.col("_before") + F.row_number().over(order))
    else:
        upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        numbered = once.withColumn("_last", F.col("_before") + upto).withColumn("rank", F.explode(F.sequence(F.col("_last") - F.col("_n") + 1, F.col("_last"))))
    drawn = numbered.select(*scored.columns, F.when(F.col("rank") <= draw, F.col("rank")).cast("long").alias("rank"))
    return drawn.unionByName(scored.filter(~surviving).select("*", none))


def scores(docs: DataFrame, target: DataFrame, key: str, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, runs: int = 1, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Per row of ``docs``: ``key``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null where not drawn)."""
    gain = gains(bucket_counts(docs, text, buckets, runs), bucket_counts(target, target_text, buckets, runs), buckets)
    scored = stored(weights(docs, gain, key, text, runs).withColumn("score", F.col("weight") + noise(F.col("key"), seed)))
    return ranked(scored, percent, least_words)


def resample(docs: DataFrame, target: DataFrame, key: str, **settings) -> DataFrame:
    """The drawn rows of ``docs``, whole, with ``rank``, which takes the place of a column of that name.

    Rows that share a key stand or fall together: their best rank counts, as a text is not joined back by more than its key.
    """
    best = scores(docs, target, key, **settings).filter("rank IS NOT NULL").groupBy(F.col("key").alias("_key")).agg(F.min("rank").alias("rank"))
    rest = docs.drop("rank") if key != "rank" else docs.withColumnRenamed(key, "_own")
    own = "_own" if key == "rank" else key
    return rest.join(best, rest[own].eqNullSafe(F.col("_key"))).drop("_key", "_own")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"), "doc_id")
    return found.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT rid, unnest(w) AS w FROM d),
v AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM b)),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN k USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
m AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS total FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY rid),
x AS (SELECT rid, doc_id, len(w) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN m USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score, CASE WHEN rank <= 10 * n // 100 THEN rank END::BIGINT AS rank FROM x LEFT JOIN r USING (rid)
"""

QUERIES = {"op11_importance_resampling": op11_importance_resampling}
ORACLES = {"op11_importance_resampling": ORACLE}
