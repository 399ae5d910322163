"""Secret scanning with an incremental ledger of blobs.

Every text is content-addressed by its SHA-256.  The ledger holds, for each blob
and rule version that was ever scanned, the spans found.  A scan takes the
distinct blobs whose (blob, rule version) the ledger lacks, runs the rules on
each of them once, and joins findings back to every row (path, version) that
carries the blob.  Only blobs with findings take part in that join; they go to every
executor behind a check of their number and bytes, beyond it blobs and rows are dealt
by blob and a salt, so that copies of one text don't meet in one task.  ``scan`` keeps
the ledger in a folder and adds to it from run to run.  All of it is DataFrame operations.

A span is ``(kind, start, end)`` in code points, end exclusive.  Matches of a
kind are leftmost and don't overlap; matches that fail the kind's test are
dropped afterwards.  Spans of different kinds may overlap.

Edge cases: a null text is an empty text; repeated rows are all answered; an
empty table gives an empty result; extra columns are never touched.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import read, shared_folder


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates; ``group`` must have ``least`` characters.  ``hint``: a cheaper test that a text with a match always passes."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: tuple[str, ...] = ()


#: Fixed patterns of the three base kinds, in the order that breaks ties.  A maximal run of at least
#: 24 hex digits, or of at least 20 characters after AKIA, is what is left of the shorter ones once they are dropped.
BASE_RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("pass", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint=("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that this scanner adds.
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", hint=("gh",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint=("eyj",)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint=("-----begin",)),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "1"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Blobs with findings, and their spans, that are sent to every executor at most; more are joined by a shuffle with SALTS parts of a blob's rows.
BROADCAST_BLOBS, BROADCAST_SPANS, SALTS = 500_000, 2_000_000, 32


def _spans(text: Column, low: Column, rule: Rule, rank: int) -> Column:
    """The spans of one rule: what lies between matches, and the matches, give the offsets."""
    pattern = F.lit(rule.pattern)
    tests = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    both = F.arrays_zip(
        F.transform(F.split(text, rule.pattern), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x)).alias("size"),
        F.transform(tests, lambda x: F.length(x)).alias("test"),
    )
    empty = F.array().cast(SPAN)
    found = F.aggregate(
        F.filter(both, lambda x: x["size"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(x["test"] >= rule.least, F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (acc["at"] + x["gap"] + x["size"]).alias("end")))))
            .otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    possible = text.rlike(rule.pattern)
    for i, word in enumerate(rule.hint):
        hinted = low.contains(word) if i == 0 else hinted | low.contains(word)  # noqa: F821
    if rule.hint:
        possible = hinted & possible
    return F.when(possible, found).otherwise(empty)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows ``(blob, rule_version, spans)`` for ``(blob, text)``; spans sorted by start, then by the rules' order."""
    low = blobs.withColumn("_low", F.lower("text"))
    every = F.concat(*(_spans(F.col("text"), F.col("_low"), r, i) for i, r in enumerate(rules)))
    return low.select("blob", F.lit(version).alias("rule_version"), F.sort_array(every).alias("spans"))


def addressed(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def update_ledger(rows: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows for the blobs of ``rows`` that ``ledger`` has not seen under ``version``; each blob is scanned once."""
    blobs = addressed(rows.select(text), text).select("blob", F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    # Equal blobs have equal texts; all but one are dropped before the shuffle already.
    return scan_blobs(blobs.groupBy("blob").agg(F.first("text").alias("text")), rules, version)


def findings(rows: DataFrame, ledger: DataFrame, text: str = "text", version: str = RULE_VERSION, keep_text: bool = False) -> DataFrame:
    """``rows`` without their text (unless ``keep_text``), with ``blob`` and the ``spans`` that the ledger has for it."""
    seen = ledger.filter((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    shape = seen.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).first()
    found = addressed(rows, text)
    if not keep_text:
        found = found.drop(text)
    if shape["n"] <= BROADCAST_BLOBS and shape["spans"] <= BROADCAST_SPANS:
        found = found.join(F.broadcast(seen), "blob", "left")
    else:
        # A row's salt is its place in the input, so that copies of one text spread.
        salted = found.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        parts = seen.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = salted.join(parts, ["blob", "_salt"], "left").drop("_salt")
    return found.withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def scan(rows: DataFrame, folder: str, text: str = "text", rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """The ledger kept at ``folder``, after the blobs of ``rows`` that it lacked under ``version`` were scanned and added."""
    spark = rows.sparkSession
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    known = path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)
    update_ledger(rows, spark.read.parquet(folder) if known else None, text, rules, version).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def new_folder(spark: SparkSession) -> str:
    """A ledger's folder that no other run uses, where all executors can write."""
    return f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"


def redact(rows: DataFrame, ledger: DataFrame, text: str = "text", mark: str = "[SECRET]", version: str = RULE_VERSION) -> DataFrame:
    """``rows`` with the characters of each secret that ``ledger`` has for their text replaced by ``mark``, overlapping spans as one.  A null text stays null."""
    # The row goes along as one column, so that its own columns may have any names.
    found = findings(rows.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), ledger, "_text", version, keep_text=True)
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= last(acc)["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    found = found.withColumn("_merged", F.when(F.size("spans") > 0, merged).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
    # What lies before each span, and after the last: pieces of the text, not copies that grow from span to span.
    whole = F.col("_text")
    before = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform("_merged", lambda x: x["end"])), F.concat(F.transform("_merged", lambda x: x["start"]), F.array(F.length(whole))),
        lambda a, b: whole.substr(a + 1, F.greatest(b - a, F.lit(0))),
    )
    masked = F.when(F.size("_merged") > 0, F.array_join(before, mark)).otherwise(whole)
    return found.select(*(masked.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in rows.columns))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings(docs, scan(docs, new_folder(spark)))
    base = F.filter("spans", lambda x: x["rank"] < len(BASE_RULES))
    counts = [F.expr(f"CAST(size(filter(spans, x -> x.kind = '{r.kind}')) AS BIGINT) AS n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT rid, {rank} AS rank, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS start_,
    unnest(list_transform(m, lambda x: length(x))) AS size, unnest(list_transform(v, lambda x: length(x))) AS test, {r.least} AS least
  FROM (SELECT rid, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS v, string_split_regex(t, '{p}') AS g FROM d)""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
k AS (SELECT rid, rank, kind, start_, kind || ':' || start_ || ':' || (start_ + size) AS piece FROM s WHERE test >= least),
a AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(piece, ',' ORDER BY start_, rank) FILTER (rank < {len(BASE_RULES)}), '') AS base, string_agg(piece, ',' ORDER BY start_, rank) AS spans
  FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLES = {"op8_secret_scan": _oracle()}
