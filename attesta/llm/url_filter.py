"""Operator 1, URL filters: path rules first, then a ratio of character language models.

A rule is a host suffix and a path prefix; the longest rule that fits decides. URLs that a rule
decides are the labelled rows from which two smoothed variable-order Markov models, of accepted and
rejected URLs, are fitted. A URL that no rule fits is rejected if the calibrated log-likelihood
difference per byte, rejected less accepted, says so.

The models interpolate orders 0 to ORDER by Witten-Bell's weights over UTF-8 bytes: a context that
wasn't seen passes its shorter one on, so that each byte is predicted by the longest context known
for it. They are fitted on all different labelled URLs but every third by hash, which is held out to calibrate: Platt's
logistic curve on the held-out differences gives the probability of rejection, and REJECT is the least that rejects.

Spark counts the grams, and no step holds a model in one place: what a byte adds to the difference depends on its window, the byte
with up to ORDER before it, so that each different window is joined to its grams and contexts once, and URLs to their windows.
Sums are of whole numbers or decimals: reruns agree. `fit` and `train` are the same for lists of URLs in memory.

Edge cases. A null URL or one without :// has empty host and path, matches no rule and is allowed,
as is every URL when either verdict lacks labelled rows. Repeated rows are judged each. Very long URLs are judged whole. Of rules
with equal length the later one wins. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm import common as c

#: Host and path of each rule, and its verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 5
REJECT = 0.9
#: Logarithms are added up as whole numbers of this fraction.
_UNIT = 1 << 32
#: Bits of a hash by which labelled URLs are put in order, bucket by bucket.
_BUCKET_BITS = 16


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(pages: DataFrame, url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """`pages` with __attesta_ columns host, path, rule and ruled (its verdict)."""
    host, path = f"{c.OWN}host", f"{c.OWN}path"
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, ruled = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return pages.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))}).withColumns({f"{c.OWN}rule": rule, f"{c.OWN}ruled": ruled})


@dataclass
class Markov:
    #: By order: sorted codes of context and byte with their counts; sorted codes of contexts with totals and kinds of followers.
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _codes(urls: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Codes of byte and context for each order, whether a place has that context, and the URL of each byte.

    The end of a URL is a byte too: 0.
    """
    parts = [u.encode("utf-8", "replace") + b"\0" for u in urls]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    b = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(parts)), size)
    place = np.arange(len(b)) - np.repeat(np.cumsum(size) - size, size)
    codes = [b]
    for k in range(1, ORDER + 1):
        back = np.zeros(len(b), np.uint64)
        back[k:] = b[:-k]
        codes.append(codes[-1] | back << np.uint64(8 * k))
    return codes, place, owner


def fit(urls: list[str]) -> Markov:
    codes, place, _ = _codes(urls)
    grams, contexts = [], []
    for k, code in enumerate(codes):
        g, n = np.unique(code[place >= k], return_counts=True)
        ctx, first = np.unique(g >> np.uint64(8), return_index=True)
        total = np.add.reduceat(n, first) if len(g) else n
        grams.append((g, n.astype(float)))
        contexts.append((ctx, total.astype(float), np.diff(np.append(first, len(g))).astype(float)))
    return Markov(grams, contexts)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def log_likelihood(model: Markov, urls: list[str]) -> np.ndarray:
    """Mean log-probability of a URL's bytes."""
    codes, place, owner = _codes(urls)
    p = np.full(len(owner), 1 / 256)
    for k, code in enumerate(codes):
        keys, total, kinds = model.contexts[k]
        at, known = _found(keys, code >> np.uint64(8))
        known &= place >= k
        at = at[known]
        g, n = model.grams[k]
        where, seen = _found(g, code[known])
        count = np.where(seen, n[where], 0.0) if len(g) else 0.0
        p[known] = (count + kinds[at] * p[known]) / (total[at] + kinds[at])
    return np.bincount(owner, weights=np.log(p), minlength=len(urls)) / np.maximum(np.bincount(owner, minlength=len(urls)), 1)


@dataclass
class Ratio:
    accepted: Markov
    rejected: Markov
    slope: float
    offset: float

    def difference(self, urls: list[str]) -> np.ndarray:
        return log_likelihood(self.rejected, urls) - log_likelihood(self.accepted, urls)

    def probability(self, urls: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(urls) + self.offset, -50, 50)))


def _newton(sums: Callable, n: tuple[int, int]) -> tuple[float, float]:
    """Slope and offset of Platt's curve, by Newton's method with a small ridge; both verdicts weigh the same.

    `sums` of slope, offset and the verdicts' targets has for each verdict the sums of p (1 - p), the same by x and by x squared, of target less p, and the same by x.
    """
    targets, weights, beta = (1 / (n[0] + 2), (n[1] + 1) / (n[1] + 2)), np.array([0.5 / max(x, 1) for x in n]), np.zeros(2)
    for _ in range(100):
        h0, h1, h2, g0, g1 = weights @ np.asarray(sums(beta[0], beta[1], targets), float)
        step = np.linalg.solve(np.array([[h2, h1], [h1, h0]]) + 1e-6 * np.eye(2), np.array([g1, g0]) - 1e-6 * beta)
        beta += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    def sums(slope: float, offset: float, targets: tuple[float, float]) -> list[list[float]]:
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -50, 50)))
        v, r = p * (1 - p), np.where(y == 1, targets[1], targets[0]) - p
        return [[z[y == k].sum() for z in (v, v * x, v * x * x, r, r * x)] for k in (0, 1)]

    return _newton(sums, (int((y == 0).sum()), int((y == 1).sum())))


def calibrate_table(held: DataFrame, n: tuple[int, int]) -> tuple[float, float]:
    """The same for a table (rejected, x), of n[0] accepted and n[1] rejected rows."""

    def sums(slope: float, offset: float, targets: tuple[float, float]) -> list[list[float]]:
        x, p = F.col("x"), probability(F.col("x"), slope, offset)
        v, r = p * (1 - p), F.when(F.col("rejected"), targets[1]).otherwise(targets[0]) - p
        rows = held.groupBy("rejected").agg(*[F.sum(z.cast("decimal(38,20)")).alias(f"s{i}") for i, z in enumerate((v, v * x, v * x * x, r, r * x))]).collect()
        found = {row["rejected"]: row[1:] for row in rows}
        return [found.get(k, [0.0] * 5) for k in (False, True)]

    return _newton(sums, n)


def probability(x: Column, slope: float, offset: float) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), slope * x + offset))))


def train(accepted: list[str], rejected: list[str]) -> Ratio | None:
    """None if either verdict has fewer than three URLs."""
    if min(len(accepted), len(rejected)) < 3:
        return None
    fits = [[u for i, u in enumerate(x) if i % 3] for x in (accepted, rejected)]
    held = [x[::3] for x in (accepted, rejected)]
    model = Ratio(fit(fits[0]), fit(fits[1]), 1.0, 0.0)
    y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    model.slope, model.offset = calibrate(model.difference(held[0] + held[1]), y)
    return model


def _scored(url: Column) -> Column:
    """What the models read: all behind ://."""
    return F.lower(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))


def windows(urls: DataFrame, *keep: str) -> DataFrame:
    """(keep, w): for each byte of `u` and the end, which is a byte too, the hexadecimal digits of it and up to ORDER bytes before it."""
    d = urls.select(*keep, F.concat(F.hex(F.col("u").cast("binary")), F.lit("00")).alias("hex"))
    return d.select(*keep, F.explode(F.expr(f"transform(sequence(1, length(hex) div 2), i -> substring(hex, 2 * greatest(i - {ORDER}, 1) - 1, 2 * least(i, {ORDER + 1})))")).alias("w"))


def _grams(d: DataFrame, *keep: str | Column) -> DataFrame:
    """(keep, gram): the last byte of each window `w` with every number of bytes before it; a gram's context is all but its last byte."""
    return d.select(*keep, F.explode(F.expr("transform(sequence(1, length(w) div 2), k -> right(w, 2 * k))")).alias("gram"))


_CONTEXT = "substring(gram, 1, length(gram) - 2)"


def labelled(ruled: DataFrame, url_col: str = "url") -> DataFrame:
    """(rejected, u, held): the different URLs that rules decide. Of each verdict's, in order of their hash, every third is held out.

    Places are counted within buckets of the hash, after what the buckets before hold: no verdict's URLs meet in a task.
    """
    rows = ruled.where(F.col(f"{c.OWN}ruled").isNotNull()).select((F.col(f"{c.OWN}ruled") == "block").alias("rejected"), _scored(F.col(url_col)).alias("u")).distinct()
    rows = rows.withColumn("h", F.xxhash64("u")).withColumn("bucket", F.shiftright("h", 64 - _BUCKET_BITS))
    rows = c.written(rows, "url-labelled")
    before = rows.groupBy("rejected", "bucket").agg(F.count("*").alias("n"))
    before = before.select("rejected", "bucket", (F.sum("n").over(Window.partitionBy("rejected").orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("rejected", "bucket").orderBy("h", "u")) - 1 + F.col("before")
    out = c.written(rows.join(before, ["rejected", "bucket"]).select("rejected", "u", (place % 3 == 0).alias("held")), "url-held")
    c.drop_written(rows)
    return out


def _joined(rows: DataFrame, table: DataFrame, key: str, how: str) -> DataFrame:
    """A join by bytes. Those of up to two bytes are 65,793 at most, but have most rows a key: they are broadcast, so that no such key lands in one task."""
    short = F.length(key) <= 4
    return rows.where(short).join(F.broadcast(table.where(short)), key, how).unionByName(rows.where(~short).join(table.where(~short), key, how))


def differences(fitted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(w, difference): of the different windows of `wanted` (w), the log-probability of the last byte when rejected less when accepted, in units; `fitted` has (rejected, u)."""
    counted = windows(fitted, "rejected").groupBy("rejected", "w").agg(F.count("*").alias("n"))
    verdicts = (("a", ~F.col("rejected")), ("r", F.col("rejected")))
    counts = [F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)).alias(f"n_{v}") for v, of in verdicts]
    grams = c.written(_grams(counted, "rejected", "n").groupBy("gram").agg(*counts), "url-grams")
    totals = [x for v, _ in verdicts for x in (F.sum(f"n_{v}").alias(f"t_{v}"), F.count(F.when(F.col(f"n_{v}") > 0, 1)).alias(f"k_{v}"))]
    contexts = grams.groupBy(F.expr(_CONTEXT).alias("context")).agg(*totals)
    rows = _grams(wanted.distinct(), "w").withColumn("context", F.expr(_CONTEXT))
    # Without a known context there is nothing to add, whatever the longer ones.
    rows = _joined(_joined(rows, contexts, "context", "inner"), grams, "gram", "left").na.fill(0, ["n_a", "n_r"])
    orders = F.array_sort(F.collect_list(F.struct(F.length("gram").alias("order"), *[f"{x}_{v}" for v, _ in verdicts for x in "ntk"])))

    def log_probability(v: str) -> Column:
        return F.log(F.aggregate("orders", F.lit(1 / 256), lambda p, x: F.when(x[f"t_{v}"] > 0, (x[f"n_{v}"] + x[f"k_{v}"] * p) / (x[f"t_{v}"] + x[f"k_{v}"])).otherwise(p)))

    return rows.groupBy("w").agg(orders.alias("orders")).select("w", F.round((log_probability("r") - log_probability("a")) * _UNIT).cast("long").alias("difference"))


def judge(pages: DataFrame, url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """`pages` with __attesta_ columns host, path, rule, verdict and rejection (the calibrated probability)."""
    ruled, p, key = apply_rules(pages, url_col, rules), f"{c.OWN}rejection", f"{c.OWN}key"
    known = labelled(ruled, url_col)
    of = {r["rejected"]: r for r in known.groupBy("rejected").agg(F.count("*").alias("n"), F.count_if("held").alias("held")).collect()}
    if min(of[v]["n"] if v in of else 0 for v in (False, True)) < 3:
        out = ruled.withColumn(p, F.lit(0.0))
    else:
        u = F.coalesce(_scored(F.col(url_col)), F.lit(""))
        urls = ruled.select(u.alias("u")).distinct().select("u", c.text_key(F.col("u")).alias(key))
        rows = c.written(windows(urls, key), "url-windows")
        by_window = differences(known.where(~F.col("held")), rows.select("w"))
        mean = F.sum(F.coalesce("difference", F.lit(0))) / F.lit(float(_UNIT)) / F.count("*")
        scored = c.written(rows.join(by_window, "w", "left").groupBy(key).agg(mean.alias(f"{c.OWN}x")), "url-differences")
        c.drop_written(rows)
        held = c.written(known.where("held").select("rejected", c.text_key(F.col("u")).alias(key)).join(scored, key).select("rejected", F.col(f"{c.OWN}x").alias("x")), "url-calibration")
        slope, offset = calibrate_table(held, (of[False]["held"], of[True]["held"]))
        c.drop_written(held)
        out = ruled.withColumn(key, c.text_key(u)).join(scored, key, "left").withColumn(p, probability(F.col(f"{c.OWN}x"), slope, offset)).drop(key, f"{c.OWN}x")
    own = F.when((F.col(p) >= REJECT) & (F.col(f"{c.OWN}host") != ""), "block").otherwise("allow")
    return out.withColumn(f"{c.OWN}verdict", F.coalesce(f"{c.OWN}ruled", own)).drop(f"{c.OWN}ruled")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(c.documents(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", *[F.col(f"{c.OWN}{x}").alias(x) for x in ("host", "path", "rule", "verdict", "rejection")])


def llm_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 1 SQL can express: hosts, paths, rules and the verdicts of rules."""
    out = op1_url_filter(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


ORACLE_SQL = {
    "llm_url_rules": """
WITH rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM rests),
fits AS (SELECT n, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS ruled FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, ruled FROM parts LEFT JOIN fits USING (n)
"""
}
