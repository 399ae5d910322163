"""Benchmark decontamination with a hash set of normalised test n-grams.

Windows of benchmark items are hashed, the distinct hashes go to every executor
(behind a check of their number and bytes), the windows of each document stream past
them, and every hit is confirmed by comparing the words.  Beyond the check the hashes
of the documents' windows, without any text, are joined with those of the benchmark by
a shuffle, and only documents with hits are looked at again to confirm them.  Hits are
then merged per document into hit words, or the document is dropped.  All of it is
DataFrame operations.

A window's hash is made of its words' hashes, halves first, so that each word is hashed
once whatever the width.

Words are maximal runs of ASCII letters, digits and non-ASCII characters of the
text with A-Z in lower case.  An item's windows are its runs of ``width`` words;
an item with fewer words is one window, one without words has none.

Edge cases: a null text has no words; an item whose id is null is matched but
not counted as an item; repeated rows are all answered; empty tables give an
empty result or no hits; extra columns are never touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import any_key, cut, lower_ascii, read, replicated, without

WIDTH = 10
#: Benchmark windows, and bytes of their words and item ids, that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 200_000_000
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), _NOT_WORD)
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    last = F.size(parts) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def _with_hashes(rows: DataFrame, widths: list[int]) -> DataFrame:
    """``rows`` with ``_h<width>``: the hashes of the runs of so many consecutive ``_words``, by their places, for each of ``widths``."""
    done = {1}
    rows = rows.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))

    def add(rows: DataFrame, width: int) -> DataFrame:
        if width in done:
            return rows
        half = 1 << (width - 1).bit_length() - 1
        rest = width - half
        rows = add(add(rows, half), rest)
        done.add(width)
        # Both parts at each place where the whole run fits; an array that is too short leaves none.
        size = F.greatest(F.size("_words") - (width - 1), F.lit(0))
        left, right = F.slice(f"_h{half}", 1, size), F.slice(f"_h{rest}", half + 1, size)
        return rows.withColumn(f"_h{width}", F.zip_with(left, right, lambda a, b: F.xxhash64(a, b)))

    for width in widths:
        rows = add(rows, width)
    return rows


def _windows(widths: list[int]) -> list[Column]:
    """For each of the hashed ``widths``: an array of (hash, 0-based place, size) of all windows."""

    def of(width: int) -> Column:
        return F.transform(f"_h{width}", lambda h, i: F.struct(h.alias("hash"), i.alias("at"), F.lit(width).alias("size")))

    return [of(width) for width in widths]


def benchmark_windows(items: DataFrame, width: int = WIDTH, item: str = "item_id", text: str = "text") -> DataFrame:
    """``(hash, size, words, items)``: each distinct window once, with the sorted ids of its items."""
    own = items.select(F.col(item).alias("_item"), words(F.col(text)).alias("_words")).filter(F.size("_words") > 0)
    # An item's windows are those of its own number of words, up to the width.
    each = _hashed(own, [*range(1, width + 1)]).select("_item", "_words", F.explode(F.filter("_w", lambda w: w["size"] == F.least(F.lit(width), F.size("_words")))).alias("w"))
    each = each.select("_item", "w.hash", "w.size", F.slice("_words", F.col("w.at") + 1, F.col("w.size")).alias("words"))
    return each.groupBy("hash", "size", "words").agg(F.sort_array(F.collect_set("_item")).alias("items"))


def _hashed(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """``docs`` with their windows, computed once: as a generator's only row they are not repeated where they are used."""
    rows = _with_hashes(docs, sizes)
    return rows.select(*docs.columns, F.explode(F.array(F.concat(F.array().cast("array<struct<hash:bigint,at:int,size:int>>"), *_windows(sizes)))).alias("_w"))


def _confirmed(hits: DataFrame, key: str, item_type: str) -> DataFrame:
    """Per ``(key, _text)`` from rows with ``n`` (of a document's own row), ``at``, ``size``, ``found`` and the window's ``own`` words."""
    same = F.when(F.col("at") >= 0, F.filter("found", lambda f: (f["size"] == F.col("size")) & (f["words"] == F.col("own"))))
    hit = hits.select(key, "_text", "n", "_copies", "at", "size", F.flatten(F.transform(same, lambda f: f["items"])).alias("items"), (F.size(same) > 0).alias("ok"))
    ids = F.array().cast(f"array<{item_type}>")
    return replicated(
        hit.groupBy(key, "_text").agg(
            F.sum("_copies").alias("_copies"),
            F.coalesce(F.max("n"), F.lit(0)).alias("n_words"),
            F.sort_array(F.collect_set(F.when(F.col("ok"), F.struct("at", "size")))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("ok"), F.coalesce("items", ids)))))).alias("items"),
        ),
        "_copies",
    ).drop("_text")


@any_key("n_words", "hits", "items")
def document_hits(docs: DataFrame, items: DataFrame, key: str, width: int = WIDTH, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key``, ``n_words``, ``hits`` (sorted places and sizes of confirmed windows) and ``items`` (distinct ids, sorted)."""
    table = benchmark_windows(items, width, item, item_text)
    table = cut(table.groupBy("hash").agg(F.collect_list(F.struct("size", "words", "items")).alias("found")))
    weight = F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + F.size(x["items"]) * 16 + F.size(x["words"]) * 24)
    shape = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("bytes"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("found", lambda x: x["size"]))))).alias("sizes")).first()
    sizes = shape["sizes"] or []
    item_type = items.schema[item].dataType.simpleString()
    base = docs.select(key, F.xxhash64(text).alias("_text"), F.col(text).alias("_whole"))
    own = F.slice("_words", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("size"))
    # A document's own row has a place of -1 and matches nothing; it keeps documents without a hit.
    if shape["n"] <= BROADCAST_WINDOWS and shape["bytes"] <= BROADCAST_BYTES:
        nothing = F.array(F.struct(F.xxhash64(key, "_text").alias("hash"), F.lit(-1).alias("at"), F.lit(0).alias("size")))
        hashed = _hashed(base.select(key, "_text", words(F.col("_whole")).alias("_words")), sizes)
        wide = hashed.select(key, "_text", "_words", F.explode(F.concat(nothing, "_w")).alias("w")).select(key, "_text", "_words", "w.*")
        joined = wide.join(F.broadcast(table), "hash", "left").filter((F.col("at") < 0) | F.col("found").isNotNull())
        first = F.col("at") < 0
        return _confirmed(joined.select(key, "_text", F.when(first, F.size("_words")).alias("n"), F.when(first, 1).alias("_copies"), "at", "size", "found", own.alias("own")), key, item_type)
    hashed = _hashed(base.select(key, "_text", words(F.col("_whole")).alias("_words")), sizes).select(key, "_text", F.explode("_w").alias("w"))
    near = hashed.select(key, "_text", "w.*").join(table.select("hash"), "hash", "left_semi").groupBy(key, "_text").agg(F.collect_set(F.struct("hash", "at", "size")).alias("_w"))
    # Equal rows are one, so that no key has more rows than it has texts.
    whole = base.groupBy(key, "_text").agg(F.count("*").alias("_copies"), F.first("_whole").alias("_whole")).select(F.col(key).alias("_key"), F.col("_text").alias("_own"), "_copies", words(F.col("_whole")).alias("_words"))
    found = whole.join(near, whole["_key"].eqNullSafe(near[key]) & (whole["_own"] == near["_text"]), "left")
    found = found.select(F.col("_key").alias(key), F.col("_own").alias("_text"), F.size("_words").alias("n"), "_copies", "_words", F.explode(F.concat(F.array(F.struct(F.xxhash64("_key", "_own").alias("hash"), F.lit(-1).alias("at"), F.lit(0).alias("size"))), F.coalesce("_w", F.array()))).alias("w"))
    light = found.select(key, "_text", F.when(F.col("w.at") < 0, F.col("n")).alias("n"), F.when(F.col("w.at") < 0, F.col("_copies")).alias("_copies"), "w.*", F.slice("_words", F.greatest(F.col("w.at"), F.lit(0)) + 1, F.col("w.size")).alias("own"))
    return _confirmed(light.join(table, "hash", "left"), key, item_type)


def hit_words(hits: Column) -> Column:
    """Number of words in the union of sorted (at, size) windows."""
    return F.aggregate(
        hits,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, w: F.struct(F.greatest(acc["end"], w["at"] + w["size"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), w["at"] + w["size"] - F.greatest(acc["end"], w["at"]))).alias("n")),
        lambda acc: acc["n"],
    )


@any_key()
def drop_contaminated(docs: DataFrame, items: DataFrame, key: str, width: int = WIDTH, most_share: float = 0.0, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without those of which more than ``most_share`` of the words are hit."""
    found = document_hits(docs, items, key, width, text, item, item_text)
    bad = found.filter(hit_words(F.col("hits")) > F.col("n_words") * F.lit(most_share)).select(key).distinct()
    return without(docs, bad, key)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = document_hits(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"), "doc_id")
    listed = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = hit_words(F.col("hits")).cast("long")
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bl)),
ks AS (SELECT DISTINCT k FROM bl),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
h AS (SELECT rid, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""

QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES = {"op7_decontaminate": ORACLE}
