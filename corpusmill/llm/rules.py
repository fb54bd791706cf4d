"""Quality rules on word statistics, with robust outliers, in DataFrame functions alone.

Base rules reject texts of fewer than 50 words or with mostly repeated words. What is left is judged
by groups of language and source: transformed statistics get a minimum-covariance-determinant
estimate, and rows of large Mahalanobis distance from it are rejected.

Concentration steps go from three starts (distances from the medians in units of the median
deviations, then from the covariance of spatial signs, and of bounded deviations); of the three
ends a group takes the one with the least determinant. To each group's sums PRIOR rows are added that
look like its language's subset, so a group of any size, even of one row, has an estimate of its own.

Features are whole numbers, so that sums do not depend on the order of addition; the subset of least
distances is found from counts by bins of the distance, so no group is ever collected or sorted.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.staging import staged

LEAST_WORDS, MOST_REPEATED = 50, 50
#: A feature's unit; the share of rows in the subset; concentration steps; rows that a language lends to each of its groups.
UNIT, SHARE, STEPS, PRIOR = 256, 0.75, 4, 20
#: Squared distance above which a row is rejected: the chi-square quantile of 1 - 4e-13 with four degrees of freedom.
CUTOFF = 64.0
#: Least standard deviation of each feature, so that groups without any spread don't reject small deviations.
#: With these, labelled documents of good quality stay below 40 on sf0.1 and bad ones above 101; repeated
#: lines alone reject from a share of 0.92 on, and repeated words, of which the base rules leave half at most, only with other features.
FEATURES = {"x0": 0.3, "x1": 0.15, "x2": 0.12, "x3": 0.12}
_WHITE, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_BINS = 8


def statistics(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word).

    A null text is empty. A three-word window is compared by a 64-bit hash of its words.
    """
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", "lang", "source", text.alias("t"))
    out = out.withColumn("w", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, _WHITE, "") != "")
    out = out.withColumns({"n_words": F.size("w").cast("long"), "lines": lines})
    out = out.withColumn("tri", F.when(F.col("n_words") >= 3, F.expr("transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2]))")))
    # Only a text with some window twice has its windows put in order.
    again = F.size("tri") > F.size(F.array_distinct("tri"))
    out = out.withColumn("s", F.when(again, F.expr("sort_array(transform(tri, (h, i) -> struct(h, i)))")))
    out = out.select("*", F.expr("sort_array(transform(filter(s, (x, i) -> (i > 0 and s[i - 1].h = x.h) or (i < size(s) - 1 and s[i + 1].h = x.h)), x -> x.i))").alias("p"))
    covered = F.expr("aggregate(transform(p, (x, i) -> if(i < size(p) - 1, least(3, p[i + 1] - x), 3)), 0L, (a, x) -> a + x)")
    return out.select(
        "doc_id", "lang", "source", "n_words",
        F.length(F.translate("t", _WHITE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def _features() -> dict[str, Column]:
    """Mean word length, log of symbols a word, root of the share of repeated lines and of words, in whole UNITs."""
    words = F.greatest("n_words", F.lit(1))
    made = [
        F.least(F.col("word_chars") / words, F.lit(60.0)),
        F.least(F.log1p(F.col("n_symbols") * 10 / words), F.lit(12.0)),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    return {name: F.round(x * UNIT).cast("long") for name, x in zip(FEATURES, made, strict=True)}


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(distance + 1e-6) * _BINS)


def _subset_limits(placed: DataFrame) -> DataFrame:
    """(g, start, limit): the bin of the distance up to which a group has its share of rows; a single row is no subset."""
    binned = placed.groupBy("g", "start", _bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("m"))
    group = Window.partitionBy("g", "start")
    counted = binned.select("g", "start", "bin", F.sum("m").over(group.orderBy("bin")).alias("up"), F.floor(F.sum("m").over(group) * SHARE).alias("need"))
    return counted.where("need > 0 and up >= need").groupBy("g", "start").agg(F.min("bin").alias("limit"))


_PAIRS = [(x, y) for i, x in enumerate(FEATURES) for y in list(FEATURES)[: i + 1]]


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """Count, sums and sums of products of the features in each group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(x).alias(f"s_{x}") for x in FEATURES), *(F.sum(F.col(x) * F.col(y)).alias(f"q_{x}_{y}") for x, y in _PAIRS))


def _with_prior(sums: DataFrame, groups: DataFrame) -> DataFrame:
    """The sums of each of `groups` (g, language) and start, with PRIOR rows of the language's sums."""
    names = ["n", *(f"s_{x}" for x in FEATURES), *(f"q_{x}_{y}" for x, y in _PAIRS)]
    found = sums.join(groups, "g")
    whole = found.groupBy("language", "start").agg(*(F.sum(c).alias(f"all_{c}") for c in names))
    every = groups.join(whole, "language").join(sums, ["g", "start"], "left")
    return every.select("g", "start", *((F.coalesce(c, F.lit(0)) + PRIOR * F.col(f"all_{c}") / F.col("all_n")).alias(c) for c in names))


def _estimates(sums: DataFrame, scale: float = 1.0) -> DataFrame:
    """Means, the Cholesky factor of the covariance times `scale`, and its determinant's logarithm, of each group and start."""
    names = list(FEATURES)
    out = sums.withColumns({f"m_{x}": F.col(f"s_{x}") / F.col("n") for x in names})
    for i, x in enumerate(names):
        for j, y in enumerate(names[: i + 1]):
            cov = (F.col(f"q_{x}_{y}") / F.col("n") - F.col(f"m_{x}") * F.col(f"m_{y}")) * scale
            if x == y:
                cov = F.greatest(cov, F.lit(0.0)) + (FEATURES[x] * UNIT) ** 2
            less = [F.col(f"l_{x}_{names[k]}") * F.col(f"l_{y}_{names[k]}") for k in range(j)]
            rest = cov - _total(less) if less else cov
            out = out.withColumn(f"l_{x}_{y}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if x == y else rest / F.col(f"l_{y}_{y}"))
    spread = _total([F.log(f"l_{x}_{x}") for x in names]) * 2
    return out.select("g", "start", *(f"m_{x}" for x in names), *(f"l_{x}_{y}" for x, y in _PAIRS), spread.alias("spread"))


def _distance() -> Column:
    """Squared Mahalanobis distance of a row's features from the estimate beside them."""
    done: dict[str, Column] = {}
    for x in FEATURES:
        off = F.col(x) - F.col(f"m_{x}")
        known = [F.col(f"l_{x}_{y}") * done[y] for y in done]
        done[x] = (off - _total(known) if known else off) / F.col(f"l_{x}_{x}")
    return _total([z * z for z in done.values()])


def _consistency(share: float, p: int = 4) -> float:
    """What makes the covariance of the nearest `share` of normal rows that of all: chi-square with p = 4 has closed forms."""
    tail = lambda x, k: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
    lo, hi = 0.0, 100.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - tail(mid, p) < share else (lo, mid)
    return share / (1 - tail(lo, p + 2))


def _starts(rows: DataFrame) -> DataFrame:
    """Rows (g, features) once for each start, with their first distances d2."""
    # Features are whole numbers in a fixed range, so exact medians need bounded memory. All small tables are
    # written down, so they meet the rows without a shuffle of those.
    middle = staged(rows.groupBy("g").agg(*(F.percentile(x, F.lit(0.5)).alias(f"c_{x}") for x in FEATURES)))
    off = rows.join(middle, "g").withColumns({f"a_{x}": F.round(F.abs(F.col(x) - F.col(f"c_{x}"))) for x in FEATURES})
    spread = off.groupBy("g").agg(*(F.percentile(f"a_{x}", F.lit(0.5)).alias(f"d_{x}") for x in FEATURES))
    known = staged(middle.join(spread, "g"))
    z = {x: (F.col(x) - F.col(f"c_{x}")) / (F.col(f"d_{x}") * 1.4826 + FEATURES[x] * UNIT) for x in FEATURES}
    length = F.sqrt(_total([v * v for v in z.values()])) + 1e-6
    plain = rows.join(known, "g").select("g", *FEATURES, F.lit(0).alias("start"), (length * length).alias("d2"))
    # Covariances of directions and of bounded deviations, in units so that sums are of whole numbers again.
    shapes = []
    for start, of in ((1, lambda v: v / length), (2, F.tanh)):
        shape = rows.join(known, "g").select("g", F.lit(start).alias("start"), *(F.round(of(v) * UNIT * FEATURES[x] * 4).cast("long").alias(x) for x, v in z.items()))
        shapes.append(_estimates(_sums(shape, "g", "start")).withColumns({f"m_{x}": F.lit(0.0) for x in FEATURES}))
    shaped = staged(shapes[0].unionByName(shapes[1]).drop("spread"))
    centred = rows.join(known, "g").select("g", *((F.col(x) - F.col(f"c_{x}")).alias(x) for x in FEATURES), *(F.col(x).alias(f"own_{x}") for x in FEATURES))
    turned = centred.join(shaped, "g").select("g", *(F.col(f"own_{x}").alias(x) for x in FEATURES), "start", _distance().alias("d2"))
    return plain.unionByName(turned)


def robust_estimates(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The estimate (g, means, factor) of each group of rows (g, features) by concentration steps; groups are (g, language)."""
    placed = _starts(rows)
    for step in range(STEPS + 1):
        near = placed.join(staged(_subset_limits(placed)), ["g", "start"]).where(_bin(F.col("d2")) <= F.col("limit"))
        sums = staged(_sums(near, "g", "start"))
        found = staged(_estimates(_with_prior(sums, groups), _consistency(SHARE) if step == STEPS else 1.0))
        placed = rows.join(found, "g").select("g", *FEATURES, "start", _distance().alias("d2"))
    least = F.row_number().over(Window.partitionBy("g").orderBy("spread", "start"))
    return staged(found.withColumn("k", least).where("k = 1").drop("k", "spread", "start"))


def judged(docs: DataFrame) -> DataFrame:
    """The statistics of every row of `docs` (doc_id, text, lang, source), base_failed, d2 and kept.

    Null languages and sources are groups of their own; a group of few rows leans on its language's
    rows, and where no group of a language has two sound rows there is no estimate: d2 is null and
    the row kept. Rows that fail the base rules are left out of the estimates and have no d2. Repeated
    rows count as often as they occur; other columns are ignored; no rows give none.
    """
    rows = statistics(docs)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    language, group = F.xxhash64("lang", F.isnull("lang")), F.xxhash64("lang", "source", F.isnull("lang"), F.isnull("source"))
    rows = staged(rows.withColumns({"base_failed": failed, "g": group, "language": language} | _features()))
    sound = rows.where("not base_failed")
    found = robust_estimates(sound.select("g", *FEATURES), staged(sound.select("g", "language").distinct()))
    shown = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = rows.join(found, "g", "left").select(*shown, F.when(~F.col("base_failed"), _distance()).alias("d2"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF))
