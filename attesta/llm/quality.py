"""Operator 2, quality rules: base rules, and robust multivariate outliers.

Base statistics come from one pass over each whole text. Then, for every language and source, the
minimum covariance determinant estimates where its documents lie: beginning at medians and
quartile distances, each concentration step keeps the H_SHARE of documents that are nearest by
Mahalanobis distance and takes their mean and covariance. The order statistics that it needs are
read from histograms, so no group meets in one task. Estimates go through a
consistency factor and one reweighting; documents beyond CUTOFF are rejected.

Every group is judged by its own estimate, drawn to the one over all documents, which is made in the same passes: of n documents that pass the base
rules, the group's estimate weighs n / (n + PRIOR). Both are taken as parts of a mixture, so that the covariance holds the distance of their centres
too. There is no size at which another rule begins; a large group's estimate is as good as its own.

Edge cases. A null text has no words and fails the base rules. Null language and source are groups
like others. Rows that repeat a document count each, and ties of distance are kept or left out together. Empty tables
give empty results. A statistic that does not vary keeps the variance in FLOORS. Very long texts are counted whole, within
their row. Other columns are kept, whatever their names: what the operator adds begins with __attesta_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm import common as c

#: Share of a group that the estimate concentrates on.
H_SHARE = 0.75
STEPS = 4
#: Documents that the estimate over all documents counts for in each group.
PRIOR = 50
#: Log length; mean length of words, symbols, repeated lines and words in repeated windows, transformed.
FEATURES = tuple(f"{c.OWN}f_{x}" for x in ("length", "word", "symbol", "line", "repeat"))
#: Least variance of each: what differs by less than this is no outlier, even where nearly all documents are equal.
FLOORS = (0.05, 0.1, 1.0, 1.0, 1.0)
#: Quantiles of chi-squared with 5 degrees of freedom: 0.75, 0.975 (reweighting), 1 - 1e-6 (rejection).
CHI_H, CHI_W, CUTOFF = 6.6257, 12.8325, 35.8882
#: P(chi-squared with 7 degrees < CHI_H) / 0.75 and P(... < CHI_W) / 0.975, inverted: consistency for normal data.
FACTOR_H, FACTOR_W = 0.75 / 0.53113, 0.975 / 0.92370
#: Bins of a histogram: of a unit of a statistic, and of a unit of a distance's logarithm.
BINS, DISTANCE_BINS = 50, 100
#: Key of the group, and its value for all groups together; no other key looks like it, as those are JSON.
GROUP, POOLED = f"{c.OWN}group", "all"
_D = len(FEATURES)


def _m(i: int) -> str:
    return f"{c.OWN}m{i}"


def _s(i: int, j: int) -> str:
    return f"{c.OWN}s{i}{j}"


def _a(i: int, j: int) -> str:
    return f"{c.OWN}a{i}{j}"


_LOWER = [(i, j) for i in range(_D) for j in range(i + 1)]
_FACTORS = [_m(i) for i in range(_D)] + [_a(i, j) for i, j in _LOWER]


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without its text, with __attesta_ columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A word is in a repeated window if one of the three windows over it is found twice in the text.
    Texts with fewer different windows than windows have theirs, each followed by its place, sorted as strings;
    neighbours that differ in place only are repeats. Words hold no space, so that a joined window stands for its words alone.
    """
    o = lambda name: f"{c.OWN}{name}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumns({
        o("words"): F.array_remove(F.split(text, c.SPACE, -1), ""),
        o("lines"): F.filter(F.split(text, "\n", -1), lambda x: x.rlike(c.WORD)),
        o("word_chars"): F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
        o("n_symbols"): (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
    }).drop(text_col)
    w, n = F.col(o("words")), F.size(o("words"))
    window = lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1), F.lit(" "), F.get(w, i + 2))
    none = F.array().cast("array<string>")
    d = d.withColumns({
        o("n_words"): n.cast("long"),
        o("n_dup_lines"): (F.size(o("lines")) - F.size(F.array_distinct(o("lines")))).cast("long"),
        o("windows"): F.when(n >= 4, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)).otherwise(none),
    }).drop(o("words"), o("lines"))
    windows = F.col(o("windows"))
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    placed = F.sort_array(F.transform(windows, lambda x, i: F.concat(x, F.lit(" "), F.lpad(i.cast("string"), 10, "0"))))
    d = d.withColumn(o("sorted"), F.when(repeats, placed).otherwise(none)).drop(o("windows"))
    # Which neighbours in sorted order begin alike, without the ten digits of the place.
    d = d.withColumn(o("heads"), F.transform(o("sorted"), lambda x: F.substring(x, F.lit(1), F.length(x) - 10)))
    heads = F.col(o("heads"))
    same = lambda i: F.coalesce(F.get(heads, i) == F.get(heads, i + 1), F.lit(False)) | F.coalesce(F.get(heads, i - 1) == F.get(heads, i), F.lit(False))
    places = F.filter(F.transform(o("sorted"), lambda x, i: F.when(same(i), F.substring(x, -10, 10).cast("int"))), lambda p: p.isNotNull())
    d = d.withColumn(o("places"), F.sort_array(places)).drop(o("sorted"), o("heads"))
    covered = F.aggregate(o("places"), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]
    d = d.withColumn(o("n_repeat_words"), covered.cast("long")).drop(o("places"))
    return d.withColumn(o("base_failed"), (F.col(o("n_words")) < 50) | (100 * F.col(o("n_repeat_words")) > 50 * F.col(o("n_words"))))


def _features(d: DataFrame) -> DataFrame:
    words, chars, symbols, lines, repeats = (F.col(f"{c.OWN}{x}") for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    n = F.greatest(words, F.lit(1)).cast("double")
    values = (F.log1p(words), F.log(F.greatest(chars, F.lit(1)) / n) * 10, F.sqrt(symbols / n) * 10, F.sqrt(lines), F.sqrt(repeats / n) * 10)
    return d.withColumns(dict(zip(FEATURES, values, strict=True)))


def _quartiles(rows: DataFrame) -> DataFrame:
    """(GROUP, n, q: of each statistic its place and quartiles), from histograms: the same in every run."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(x) * BINS).alias("bin")) for i, x in enumerate(FEATURES)])
    bins = rows.select(GROUP, F.explode(cells).alias("cell")).groupBy(GROUP, "cell.i", "cell.bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(GROUP, "i")
    bins = bins.withColumns({"to": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    at = lambda share: F.min(F.when(F.col("to") >= F.col("all") * share, (F.col("bin") + 0.5) / BINS))
    by = bins.groupBy(GROUP, "i").agg(F.first("all").alias("n"), *[at(s).alias(f"q{k}") for k, s in enumerate((0.25, 0.5, 0.75))])
    return by.groupBy(GROUP).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "q0", "q1", "q2"))).alias("q"))


def _moments(d: DataFrame, scale: float) -> DataFrame:
    """Mean and covariance by group, the latter times `scale`."""
    f = [F.col(x) for x in FEATURES]
    out = d.groupBy(GROUP).agg(*[F.avg(f[i]).alias(_m(i)) for i in range(_D)], *[F.covar_pop(f[i], f[j]).alias(_s(i, j)) for i, j in _LOWER])
    return out.withColumns({_s(i, j): F.coalesce(F.col(_s(i, j)), F.lit(0.0)) * scale + (FLOORS[i] if i == j else 0.0) for i, j in _LOWER})


def _inverted(stats: DataFrame) -> DataFrame:
    """`stats` with the inverse of the covariance's Cholesky factor in place of the covariance, written out row by row."""
    low = {(i, j): f"{c.OWN}l{i}{j}" for i, j in _LOWER}
    for j in range(_D):
        for i in range(j, _D):
            rest = F.col(_s(i, j))
            for k in range(j):
                rest = rest - F.col(low[i, k]) * F.col(low[j, k])
            stats = stats.withColumn(low[i, j], F.sqrt(F.greatest(rest, F.lit(FLOORS[i] / 10))) if i == j else rest / F.col(low[j, j]))
    for j in range(_D):
        for i in range(j, _D):
            total = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                total = total - F.col(low[i, k]) * F.col(_a(k, j))
            stats = stats.withColumn(_a(i, j), total / F.col(low[i, i]))
    return stats.drop(*low.values(), *[_s(i, j) for i, j in _LOWER])


def _distance(d: DataFrame) -> DataFrame:
    """`d` joined with what `_inverted` returns, with __attesta_d2: the squared Mahalanobis distance."""
    total = F.lit(0.0)
    for i in range(_D):
        z = F.lit(0.0)
        for k in range(i + 1):
            z = z + F.col(_a(i, k)) * (F.col(FEATURES[k]) - F.col(_m(k)))
        total = total + z * z
    return d.withColumn(f"{c.OWN}d2", total).drop(*_FACTORS)


def _last_bins(d: DataFrame) -> DataFrame:
    """(GROUP, last): the last of the bins of distance that hold a group's nearest H_SHARE."""
    bins = d.groupBy(GROUP, _bin().alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(GROUP)
    bins = bins.withColumns({"to": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    return bins.where(F.col("to") >= F.ceil(F.col("all") * H_SHARE)).groupBy(GROUP).agg(F.min("bin").alias("last"))


def _bin() -> Column:
    return F.floor(F.log(F.greatest(F.col(f"{c.OWN}d2"), F.lit(1e-6))) * DISTANCE_BINS).cast("int")


def estimates(rows: DataFrame) -> DataFrame:
    """Robust location and scatter of `rows` (GROUP, FEATURES) by group: means, covariances, and n rows.

    Rows meet written tables of one row a group only, which Spark broadcasts while they are small: a hot group stays where it is.
    """
    start = c.written(_quartiles(rows), "mcd-quartiles")
    q = lambda i, k: F.col("q")[i][f"q{k}"]
    stats = start.select(GROUP, *[q(i, 1).alias(_m(i)) for i in range(_D)], *[(F.pow((q(i, 2) - q(i, 0)) / 1.349, F.lit(2)) + FLOORS[i] if i == j else F.lit(0.0)).alias(_s(i, j)) for i, j in _LOWER])
    stats = c.written(_inverted(stats), "mcd-0")
    for step in range(STEPS):
        placed = _distance(rows.join(stats, GROUP))
        last = c.written(_last_bins(placed), "mcd-last")
        near = placed.join(last, GROUP).where(_bin() <= F.col("last"))
        old, stats = stats, c.written(_inverted(_moments(near, FACTOR_H)), f"mcd-{step + 1}")
        c.drop_written(old, last)
    near = _distance(rows.join(stats, GROUP)).where(F.col(f"{c.OWN}d2") <= CHI_W)
    out = c.written(_moments(near, FACTOR_W).join(start.select(GROUP, "n"), GROUP), "mcd")
    c.drop_written(start, stats)
    return out


def drawn(own: DataFrame, pooled: Row, prior: int = PRIOR) -> DataFrame:
    """Each group's estimate in a mixture with the pooled one, as _FACTORS: the parts weigh as their documents, the pooled one as `prior`."""
    w = F.col("n") / (F.col("n") + prior)
    apart = [F.col(_m(i)) - pooled[_m(i)] for i in range(_D)]
    mixed = {_s(i, j): w * F.col(_s(i, j)) + (1 - w) * pooled[_s(i, j)] + w * (1 - w) * apart[i] * apart[j] for i, j in _LOWER}
    means = {_m(i): w * F.col(_m(i)) + (1 - w) * pooled[_m(i)] for i in range(_D)}
    return _inverted(own.select(GROUP, *[x.alias(name) for name, x in (means | mixed).items()]))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """`docs` without its text, with __attesta_ columns: the base statistics, base_failed, distance (squared; null if the base rules failed) and kept."""
    failed, d2 = F.col(f"{c.OWN}base_failed"), f"{c.OWN}d2"
    d = docs.withColumn(GROUP, F.to_json(F.struct(F.col(lang_col).alias("l"), F.col(source_col).alias("s"))))
    d = c.written(_features(base_statistics(d, text_col)), "quality")
    # Each document counts for its group and for all of them.
    rows = d.where(~failed).select(F.explode(F.array(F.col(GROUP), F.lit(POOLED))).alias(GROUP), *FEATURES)
    found = estimates(rows)
    pooled = found.where(F.col(GROUP) == POOLED).first()
    if pooled is None and not found.isEmpty():
        raise RuntimeError("the estimate over all groups is missing")
    own = found.where(F.col(GROUP) != POOLED)
    # Without any estimate no document passed the base rules.
    own = drawn(own, pooled) if pooled else own.select(GROUP, *[F.lit(None).cast("double").alias(x) for x in _FACTORS])
    d = _distance(d.join(own.select(GROUP, *_FACTORS), GROUP, "left"))
    kept = ~failed & ~F.coalesce(F.col(d2) > CUTOFF, F.lit(False))
    return d.withColumn(f"{c.OWN}distance", F.when(~failed, F.col(d2))).withColumn(f"{c.OWN}kept", kept).drop(d2, GROUP, *FEATURES)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(c.documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    return out.select("doc_id", *[F.col(f"{c.OWN}{x}").alias(x) for x in names])


def llm_quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 2 SQL can express: the base statistics and rules."""
    return op2_quality_rules(spark, sf_dir).drop("kept", "distance")


ORACLE_SQL = {
    "llm_quality_base": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
covered AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY k),
stats AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered USING (k)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats
"""
}
