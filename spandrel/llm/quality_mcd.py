"""Quality rules as robust multivariate outliers.

Six statistics of each text are transformed so that ordinary texts scatter
roughly evenly about a centre, and kept as integers in units of 1/100.  Per
language and source a minimum-covariance-determinant estimate is made, from three
starts: medians with interquartile ranges, medians with the covariance of spatial
signs, and the mean and covariance of all rows.  From each, concentration steps keep
the three quarters of the rows with the smallest distance and take their mean and
covariance anew, as long as the determinant falls; the start that ends with the
smallest determinant is taken.  A row whose squared Mahalanobis distance exceeds
``most`` is rejected.  A group with fewer than ``least_rows`` rows joins the pool of its
language, a pool that is still small the pool of all; where even that is small
nothing is rejected by distance.

The steps are aggregations: a step counts rows and sums moments per group and
distance bin (sums that Spark combines before the shuffle, over integers, so
they don't depend on the order of rows), and only those small tables are sorted.
Rows of the bin in which the three quarters end count with the part that fills them.
A constant statistic would make every deviation infinite, so each has a least
scale, added to the diagonal.

Repeated 3-word windows are found within the row by a 64-bit hash of their words.
All of it is DataFrame operations.

Edge cases: rows at the same distance are in the same bin and count alike; a row
at the bound itself is kept; a null text has no words and fails the base rules; a null language
or source is a group of its own; repeated rows are all answered; an empty table
gives an empty result; extra columns are never touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SPACE, SPACE_CHARS, UPPER, cut, read, stored

SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Names of the transformed statistics, their formulas over the counts, and least scales (in 1/100).
STATISTICS = {
    "x0": ("ln(1 + 200.0 * n_symbols / (word_chars + 50))", 25.0),
    "x1": ("ln(1 + 10.0 * n_repeat_words / (n_words + 20))", 25.0),
    "x2": ("ln(1 + 20.0 * n_upper / (word_chars + 50))", 12.0),
    "x3": ("ln(1 + 20.0 * n_punct / (word_chars + 50))", 12.0),
    "x4": ("2 * ln((word_chars + 50.0) / (n_words + 10))", 12.0),
    "x5": ("ln(1 + 10.0 * n_dup_lines / (n_lines + 2))", 25.0),
}
NAMES = tuple(STATISTICS)
P = len(NAMES)
#: A squared distance that a clean text rarely reaches: some eleven least scales from the centre.  It is no quantile of
#: chi-square, as the statistics of clean texts are narrow with long tails: their distances have a median of 0.4, where
#: normal vectors have 5.3, and yet a maximum of 40 to 47 on the test tables.
MOST = 120.0
LEAST_ROWS = 200
SHARE = 0.75
#: Concentration steps at most, and how much the determinant's logarithm must fall for another one.
MOST_STEPS, LEAST_FALL = 12, 1e-3
#: Makes the covariance of the nearest 75 % of 6-dimensional normal vectors that of all.
CONSISTENCY = 1.36
BROADCAST_GROUPS = 50_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct")
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


#: Words covered by 3-word windows at the sorted places of repeated windows.
_COVERED = "aggregate(zip_with(_places, slice(_places, 2, size(_places)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x)"
#: SPACE_CHARS as the text of a SQL literal, which knows few escapes.
_SPACES = "".join(f"\\u{ord(c):04X}" for c in SPACE_CHARS)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of COUNTS of its text, all computed within the row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_t", whole).withColumn("_trimmed", F.expr(f"btrim(_t, '{_SPACES}')"))
    out = out.withColumn("_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", f"[{SPACE}]+")))
    out = out.withColumn("_hashes", F.expr("CASE WHEN size(_words) < 4 THEN array() ELSE transform(sequence(1, size(_words) - 2), i -> xxhash64(_words[i - 1], _words[i], _words[i + 1])) END"))
    out = out.withColumn("_sorted", F.sort_array("_hashes"))
    out = out.withColumn("_dups", F.expr("CASE WHEN size(_sorted) < 2 THEN array() ELSE filter(zip_with(slice(_sorted, 1, size(_sorted) - 1), slice(_sorted, 2, size(_sorted)), (a, b) -> CASE WHEN a = b THEN a END), x -> x IS NOT NULL) END"))
    # Few repeated windows are looked up; many are found by sorting (hash, place) pairs, which takes n log n whatever the text.
    out = out.withColumn("_pairs", F.expr("CASE WHEN size(_dups) > 16 THEN sort_array(transform(_hashes, (h, i) -> struct(h, i))) END"))
    out = out.withColumn("_places", F.expr("""
      CASE WHEN size(_dups) = 0 THEN array()
      WHEN size(_dups) <= 16 THEN filter(sequence(1, size(_hashes)), i -> array_contains(_dups, _hashes[i - 1]))
      ELSE sort_array(array_distinct(flatten(filter(zip_with(_pairs, slice(_pairs, 2, size(_pairs)), (a, b) -> CASE WHEN a.h = b.h THEN array(a.i, b.i) END), x -> x IS NOT NULL)))) END"""))
    out = out.withColumn("_lines", F.expr(f"filter(split(_t, '\\n'), x -> btrim(x, '{_SPACES}') <> '')"))
    left = lambda chars: (F.length("_t") - F.length(F.translate("_t", chars, ""))).cast("long")
    counts = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_t", SPACE_CHARS, "")).cast("long"),
        "n_symbols": left(SYMBOLS),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.expr(_COVERED),
        "n_lines": F.size("_lines").cast("long"),
        "n_upper": left(UPPER),
        "n_punct": left(PUNCTUATION),
    }
    # As a generator's only row, the counts are computed once: a later filter on them is not moved below, which would repeat their whole expressions.
    return out.select(*docs.columns, F.inline(F.array(F.struct(*(c.alias(k) for k, c in counts.items())))))


def _rounded(formula: str) -> str:
    return f"CAST(floor(100 * ({formula}) + 0.5) AS BIGINT)"


def with_statistics(rows: DataFrame) -> DataFrame:
    return rows.withColumns({x: F.expr(_rounded(f)) for x, (f, _) in STATISTICS.items()}).withColumn("base_failed", F.expr(BASE_FAILED))


def _distance(mean: str = "m", inverse: str = "r") -> str:
    """Squared distance as text: r is the inverse of the covariance's lower triangular root."""
    return " + ".join(f"pow({' + '.join(f'{inverse}{i}{j} * (x{j} - {mean}{j})' for j in range(i + 1))}, 2)" for i in range(P))


_BIN = "CAST(greatest(-100, floor(8 * ln({d} + 1e-9))) AS BIGINT)"
_SUMS = ["count(*) AS n", *(f"sum(x{i}) AS s{i}" for i in range(P)), *(f"sum(x{i} * x{j}) AS q{i}{j}" for i in range(P) for j in range(i + 1))]
_PARTS = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i in range(P) for j in range(i + 1))]


_MOMENTS = {f"m{i}": f"CAST(s{i} AS DOUBLE) / n" for i in range(P)}, {f"c{i}{j}": f"{CONSISTENCY} * (CAST(q{i}{j} AS DOUBLE) / n - m{i} * m{j})" for i in range(P) for j in range(i + 1)}


def _root_steps() -> list[dict[str, str]]:
    """Column by column, as text: covariances ``c`` with least scales, their Cholesky root ``l``, its inverse ``r``, and half the logarithm of the determinant."""
    scales = [s for _, s in STATISTICS.values()]
    steps = [{f"c{i}{i}": f"c{i}{i} + {scales[i] ** 2}" for i in range(P)}]
    for i in range(P):
        for j in range(i + 1):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            steps.append({f"l{i}{j}": f"sqrt(greatest(c{i}{i}{inner}, 1.0))" if i == j else f"(c{i}{j}{inner}) / l{j}{j}"})
    for i in range(P):
        steps.append({f"r{i}{j}": f"1 / l{i}{i}" if i == j else f"-({' + '.join(f'l{i}{k} * r{k}{j}' for k in range(j, i))}) / l{i}{i}" for j in range(i + 1)})
    return [*steps, {"size": " + ".join(f"ln(l{i}{i})" for i in range(P))}]


#: A model: its group, the start it came from, centre, inverse root, and the size of its determinant.
_PLACE = [*(f"m{i}" for i in range(P)), *(f"r{i}{j}" for i in range(P) for j in range(i + 1))]
_MODEL = ["g", "start", *_PLACE, "size"]


def _with(out: DataFrame, *steps: dict[str, str]) -> DataFrame:
    for step in steps:
        out = out.withColumns({k: F.expr(v) for k, v in step.items()})
    return out


def _starts(rows: DataFrame, small: bool) -> DataFrame:
    """Three models a group.  The statistics are small integers, so exact percentiles need one counter a value."""
    quartiles = rows.groupBy("g").agg(*(F.expr(f"percentile(x{i}, array(0.25, 0.5, 0.75)) AS p{i}") for i in range(P)))
    centre = cut(quartiles.select("g", *(F.expr(f"p{i}[1] AS m{i}") for i in range(P)), *(F.expr(f"greatest((p{i}[2] - p{i}[0]) * 0.7413, 1.0) AS w{i}") for i in range(P))))
    ranges = _with(centre, {f"c{i}{j}": f"pow(w{i}, 2)" if i == j else "0.0D" for i in range(P) for j in range(i + 1)}, *_root_steps()).withColumn("start", F.lit(0))
    # Directions from the centre in hundredths, so that their sums are whole numbers.
    scaled = _with(rows.join(F.broadcast(centre) if small else centre, "g"), {f"z{i}": f"(x{i} - m{i}) / w{i}" for i in range(P)}, {"_far": f"sqrt({' + '.join(f'z{i} * z{i}' for i in range(P))}) + 1e-9"}, {f"u{i}": f"CAST(round(100 * z{i} / _far) AS BIGINT)" for i in range(P)})
    sums = scaled.groupBy("g").agg(F.count("*").alias("n"), *(F.expr(f"sum(u{i} * u{j}) AS q{i}{j}") for i in range(P) for j in range(i + 1)))
    signs = _with(sums.join(centre, "g"), {f"c{i}{j}": f"{P} * w{i} * w{j} * CAST(q{i}{j} AS DOUBLE) / n / 10000" for i in range(P) for j in range(i + 1)}, *_root_steps()).withColumn("start", F.lit(1))
    whole = _with(rows.groupBy("g").agg(*map(F.expr, _SUMS)), *_MOMENTS, *_root_steps()).withColumn("start", F.lit(2))
    # No step has been taken yet, so the first one counts as a fall whatever it gives.
    return signs.select(*_MODEL).union(ranges.select(*_MODEL)).union(whole.select(*_MODEL)).withColumn("size", F.lit(float("inf")))


def _concentrate(rows: DataFrame, model: DataFrame, small: bool) -> DataFrame:
    """The next estimates: mean and covariance of each group's nearest rows under each model."""
    near = rows.join(F.broadcast(model) if small else model, "g").withColumn("bin", F.expr(_BIN.format(d=f"({_distance()})")))
    bins = near.groupBy("g", "start", "bin").agg(*map(F.expr, _SUMS))
    ahead = "OVER (PARTITION BY g, start ORDER BY bin)"
    held = bins.withColumns({"_before": F.expr(f"sum(n) {ahead} - n"), "_h": F.expr(f"ceil({SHARE} * sum(n) OVER (PARTITION BY g, start))")}).filter("_before < _h")
    part = F.expr("least(1.0D, (_h - _before) / n)")
    out = held.groupBy("g", "start").agg(*(F.sum(F.col(c) * part).alias(c) for c in _PARTS))
    return _with(out, *_MOMENTS, *_root_steps()).select(*_MODEL)


def groups(sizes: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``(lang, source, g)``: the group of each language and source, from ``(lang, source, n)``."""
    # Names can't meet: '0' pools all, '1...' a language, '2...' a language and source; a null is told from any text.
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    sized = sizes.withColumns({"_lang": F.concat(F.lit("1"), part("lang")), "_own": F.concat(F.lit("2"), part("lang"), F.lit("/"), part("source"))})
    sized = sized.withColumn("_small", F.when(F.col("n") < least_rows, F.col("n")).otherwise(0))
    pools = sized.groupBy("_lang").agg(F.sum("_small").alias("_pool"))
    named = sized.join(pools, "_lang").withColumn("g", F.when(F.col("n") >= least_rows, F.col("_own")).when(F.col("_pool") >= least_rows, F.col("_lang")).otherwise("0"))
    return named.select("lang", "source", "g")


def estimate(rows: DataFrame, least_rows: int = LEAST_ROWS, most_steps: int = MOST_STEPS) -> DataFrame:
    """Per (lang, source): the robust centre and inverse root of its group, from rows with statistics; rows that fail the base rules don't count."""
    able = rows.filter(~F.col("base_failed"))
    named = cut(groups(able.groupBy("lang", "source").agg(F.count("*").alias("n")), least_rows))
    small = named.count() <= BROADCAST_GROUPS
    same = [able[c].eqNullSafe(named[c]) for c in ("lang", "source")]
    inputs = able.join(F.broadcast(named) if small else named, same[0] & same[1]).select("g", *NAMES)
    enough = inputs.groupBy("g").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min(least_rows, 2 * P * P)).select("g")
    model = cut(_starts(inputs, small))
    for _ in range(most_steps):
        after = _concentrate(inputs, model, small).select("g", "start", F.struct(*_PLACE, "size").alias("_after"))
        fell = F.col("_after.size") < F.col("size") - LEAST_FALL
        both = cut(model.join(after, ["g", "start"]).select("g", "start", *(F.when(fell, F.col(f"_after.{c}")).otherwise(F.col(c)).alias(c) for c in (*_PLACE, "size")), fell.alias("_fell")))
        model = both.drop("_fell")
        if both.filter("_fell").isEmpty():
            break
    best = model.groupBy("g").agg(F.min_by(F.struct(*_PLACE), F.struct("size", "start")).alias("_best")).select("g", "_best.*")
    return cut(named.join(best.join(enough, "g"), "g", "left").select("lang", "source", *_PLACE))


def judge(rows: DataFrame, model: DataFrame, most: float = MOST) -> DataFrame:
    """``rows`` with ``distance`` (null without an estimate) and ``kept``."""
    own = model.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = rows["lang"].eqNullSafe(own["_lang"]) & rows["source"].eqNullSafe(own["_source"])
    joined = rows.join(F.broadcast(own) if model.count() <= BROADCAST_GROUPS else own, same, "left")
    out = joined.withColumn("distance", F.expr(_distance())).drop("_lang", "_source", *_PLACE)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= most))


def keep_inliers(docs: DataFrame) -> DataFrame:
    """``docs`` (with text, lang and source) without the rows that the rules reject.  Rows are written once with their statistics, as the counts cost more than that."""
    # The row goes along as one column, so that its own columns may have any names.
    carried = docs.select(F.struct("*").alias("_row"), "text", "lang", "source")
    rows = stored(with_statistics(with_counts(carried)).select("_row", "lang", "source", "base_failed", *NAMES))
    return judge(rows, estimate(rows)).filter("kept").select("_row.*")


def op10_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = cut(with_statistics(with_counts(docs)).select("doc_id", "lang", "source", *COUNTS, "base_failed", *NAMES))
    return judge(rows, estimate(rows)).select("doc_id", *COUNTS[:5], "base_failed", "kept", "distance")


QUERIES = {"op10_quality_mcd": op10_quality_mcd}
ORACLES: dict[str, str] = {}
