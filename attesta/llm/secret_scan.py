"""Operator 7, secret scans: patterns for known kinds, and a battery of randomness tests.

Base kinds are regular expressions with a least length. Java's `split` and `regexp_extract_all` see
the same leftmost non-overlapping matches, so lengths of pieces and matches give every span's
place; they are summed by a window over the exploded matches, in linear time however many a text has.

The method looks at each other run of 20 or more characters of [A-Za-z0-9+/_=-] in which an
encoding can be inferred (hex, base32, base36, base62, base64): single-case words and numbers
have none. The battery has three tests in that encoding: chi-squared uniformity over the
alphabet, the runs test over character classes, and lag-1 serial correlation of alphabet places.
Each statistic is read twice. Against randomness, Stouffer's sum of the three must not reject. Against
structured text, the least structure that counts (STRUCTURE) moves the law of each statistic: chi-squared
becomes noncentral, runs are fewer, neighbours are alike, all of it the clearer the longer a run is. A run is
structured if any test says so, so the largest of the three one-sided p-values of that null (intersection-union) goes to
Benjamini-Hochberg, within strata of length, which bounds the share of false discoveries among what is added.

All of it depends on the text alone and is done once for each different text, so that copies don't
weigh on the false-discovery control.

Edge cases. A null or empty text has no spans, the digest of the empty string. Rows that
repeat an id are judged row by row. Spans are in code points, end exclusive. A candidate that
overlaps a base span is not added. Equal p-values are discoveries together or not at all. Very long texts are read whole, and
the spans of a text meet in one task. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm import common as c

#: kind: (pattern, group whose length counts, least length); in the order of ties.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # A run's leftmost match takes the whole run: asking for the length at once is the same.
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "random": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
NAMES = list(KINDS)
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: encoding: (pattern of the run without padding, alphabet)
ENCODINGS = {
    "hex": (r"^(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "ABCDEFabcdef"),
    "base32": (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567"),
    "base36": (r"^(?=.*[0-9])(?=.*[A-Za-z])([a-z0-9]+|[A-Z0-9]+)$", _DIGITS + _UPPER + _LOWER),
    "base62": (r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    "base64": (r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+$", _UPPER + _LOWER + _DIGITS + "+-/_"),
}
#: Letters of the alphabet that a run of the encoding can use at once.
RADIX = {"hex": 16, "base32": 32, "base36": 36, "base62": 62, "base64": 64}
STRATA = (24, 32, 48, 96)
FDR = 0.01
MOST_Z = 2.33
#: Structured text, at least: equal pairs of characters to those of a uniform alphabet, runs of classes to those of a random order, correlation.
STRUCTURE = (3.0, 0.25, 0.8)
#: Bytes of spans that are broadcast to the documents rather than shuffling them, at most.
BROADCAST_BYTES = 32 << 20
_BINS = 100


def _lengths(text: Column, kind: str) -> Column:
    """Per match: (length of the text before it since the last match, its length, length that counts); null if none."""
    pattern, group, _ = KINDS[kind]
    before = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counts = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    body = found if kind == "random" else F.array().cast("array<string>")
    all_ = F.arrays_zip(before.alias("b"), found.alias("f"), counts.alias("n"), body.alias("s"))
    rows = F.transform(F.filter(all_, lambda x: x["f"].isNotNull()), lambda x: F.struct(F.length(x["b"]).alias("gap"), F.length(x["f"]).alias("len"), F.length(x["n"]).alias("counts"), x["s"].alias("body")))
    return F.when(text.rlike(pattern), rows)


def battery(tokens: DataFrame) -> DataFrame:
    """`tokens` (column body) with encoding, n (its length), z (sum of the tests against randomness), against (the least of the tests against structure, as a normal score that falls with it), stratum and bin (of -log10 p against structure)."""
    run = F.rtrim(F.col("body"), F.lit("="))
    enc = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(ENCODINGS.items()):
        enc = F.when(run.rlike(pattern), name).otherwise(enc)
    t = tokens.withColumns({"run": run, "encoding": enc}).where(F.col("encoding").isNotNull() & (F.length("run") >= KINDS["random"][2]))
    alphabet, radix = F.lit(""), F.lit(64.0)
    for name, (_, letters) in ENCODINGS.items():
        alphabet = F.when(F.col("encoding") == name, letters).otherwise(alphabet)
        radix = F.when(F.col("encoding") == name, float(RADIX[name])).otherwise(radix)
    t = t.withColumns({"alphabet": alphabet, "k": radix, "n": F.length("run").cast("double")})
    counts = F.transform(F.split("alphabet", ""), lambda ch: F.when(ch == "", F.lit(0)).otherwise(F.length("run") - F.length(F.replace(F.col("run"), ch, F.lit("")))).cast("double"))
    sq = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)
    classes = F.array(*[F.regexp_count("run", F.lit(x)).cast("double") for x in ("[A-Z]", "[a-z]", "[0-9]", "[^A-Za-z0-9]")])
    t = t.withColumns({"sq": sq, "classes": classes, "runs": F.regexp_count("run", F.lit("[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+")).cast("double")})
    t = t.withColumns({"s2": F.aggregate("classes", F.lit(0.0), lambda a, x: a + x * x), "s3": F.aggregate("classes", F.lit(0.0), lambda a, x: a + x * x * x)})
    places = F.transform(F.split("run", ""), lambda ch: F.instr(F.col("alphabet"), ch).cast("double"))
    t = t.withColumn("x", F.filter(places, lambda v: v > 0))
    t = t.withColumn("mean", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.col("n"))
    t = t.withColumn("d", F.transform("x", lambda v: v - F.col("mean")))
    lag = F.aggregate(F.zip_with("d", F.slice(F.col("d"), F.lit(2), F.greatest(F.size("d") - 1, F.lit(0))), lambda a, b: a * F.coalesce(b, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
    var = F.aggregate("d", F.lit(0.0), lambda a, v: a + v * v)
    n, k, df = F.col("n"), F.col("k"), F.col("k") - 1
    pairs, share, correlation = STRUCTURE
    chi = k / n * F.col("sq") - n
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # The noncentral law's mean is df + beyond, its variance 2 df + 4 beyond.
    beyond = n * (pairs - 1)
    z_chi_structure = (chi - df - beyond) / F.sqrt(2 * df + 4 * beyond)
    spread = (F.col("s2") * (F.col("s2") + n * (n + 1)) - 2 * n * F.col("s3") - F.pow(n, F.lit(3))) / (n * n * (n - 1))
    more = n - F.col("s2") / n  # runs of a random order, but for the first
    z_runs = F.when(spread > 1e-9, (F.col("runs") - 1 - more) / F.sqrt(spread)).otherwise(0.0)
    z_runs_structure = (F.col("runs") - 1 - share * more) / F.sqrt(spread)
    r = F.when(var > 0, F.abs(lag / var)).otherwise(1.0)
    z_lag = F.when(var > 0, r * F.sqrt(n)).otherwise(99.0)
    z_lag_structure = (r - correlation) * F.sqrt(n)
    z = (z_chi - z_runs + (z_lag - 0.8) / 0.6) / math.sqrt(3)
    # One class of characters has no runs to speak of: the other two tests decide.
    against = F.greatest(z_chi_structure, z_lag_structure, F.when(spread > 1e-9, -z_runs_structure))
    # The normal law's upper tail is about exp(-0.717 x - 0.416 x^2) / 2.
    log_p = F.when(against < 0, math.log10(2) + (-0.717 * against + 0.416 * against * against) / math.log(10)).otherwise(0.0)
    stratum = sum(((F.col("n") >= x).cast("int") for x in STRATA[1:]), (F.col("n") >= STRATA[0]).cast("int"))
    return t.withColumns({"z": z, "against": against, "stratum": stratum, "bin": F.least(F.floor(log_p * _BINS), F.lit(30 * _BINS)).cast("int")}).drop("alphabet", "classes", "runs", "sq", "s2", "s3", "x", "d", "mean", "k", "run")


def thresholds(tokens: DataFrame) -> Column:
    """Whether a token of `battery` is a discovery: Benjamini-Hochberg over bins of -log10 p in each stratum.

    At most one number a stratum comes to the driver.
    """
    bins = tokens.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    rank, m = F.sum("n").over(w), F.sum("n").over(Window.partitionBy("stratum"))
    passing = bins.withColumn("ok", F.pow(F.lit(10.0), -F.col("bin") / _BINS) <= FDR * rank / m).where("ok")
    least = {r["stratum"]: r["b"] for r in passing.groupBy("stratum").agg(F.min("bin").alias("b")).collect()}
    ok = F.lit(False)
    for stratum, b in least.items():
        ok = ok | ((F.col("stratum") == stratum) & (F.col("bin") >= b))
    return ok & (F.col("z") <= MOST_Z)


def find(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(`docs` without its text and with __attesta_key, spans by key: key, spans array<struct<start,kind,stop>>).

    kind is a place in NAMES.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.withColumn(f"{c.OWN}key", c.text_key(text))
    for kind in NAMES:
        slim = slim.withColumn(c.OWN + kind, _lengths(text, kind))
    slim = c.written(slim.drop(text_col), "secrets")
    some = F.coalesce(*[F.col(c.OWN + k) for k in ("assign", "access", "hex", "random")]).isNotNull()
    hits = slim.where(some).groupBy(F.col(f"{c.OWN}key").alias("key")).agg(*[F.first(c.OWN + k).alias(k) for k in NAMES])
    rows = None
    for i, kind in enumerate(NAMES):
        part = hits.select("key", F.lit(i).alias("kind"), F.posexplode(kind).alias("pos", "m")).select("key", "kind", "pos", "m.*")
        rows = part if rows is None else rows.unionByName(part)
    w = Window.partitionBy("key", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(w)).withColumn("start", F.col("stop") - F.col("len"))
    least = F.element_at(F.array(*[F.lit(KINDS[k][2]) for k in NAMES]), F.col("kind") + 1)
    rows = rows.where(F.col("counts") >= least)
    base = F.col("kind") < NAMES.index("random")
    before = Window.partitionBy("key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("key").orderBy("start", "stop").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"left": F.max(F.when(base, F.col("stop"))).over(before), "right": F.min(F.when(base, F.col("start"))).over(after)})
    rows = rows.where(base | ((F.coalesce("left", F.lit(0)) <= F.col("start")) & (F.coalesce("right", F.col("stop")) >= F.col("stop"))))
    rows = c.written(rows.select("key", "kind", "start", "stop", "body"), "secrets-rows")
    tokens = battery(rows.where(~base))
    added = tokens.where(thresholds(tokens)).select("key", "kind", "start", "stop")
    spans = rows.where(base).select("key", "kind", "start", "stop").unionByName(added)
    spans = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("spans"))
    return slim.drop(*[c.OWN + k for k in NAMES]), spans


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim, spans = find(c.documents(spark, sf_dir).select("doc_id", "text"))
    names = F.array(*[F.lit(n) for n in NAMES])
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == NAMES.index(k))).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < NAMES.index("random"))
    spans = spans.select("key", *[n(k).alias(f"n_{k}") for k in NAMES], listed(base).alias("base"), listed(F.col("spans")).alias("spans"))
    # Copies of one text share a key: spans go to the documents while they are few, else adaptive execution splits hot keys.
    spans = c.sized_broadcast(c.written(spans, "secrets-spans"), BROADCAST_BYTES // 64, F.octet_length("spans") + F.octet_length("base") + 100, BROADCAST_BYTES)
    out = slim.join(spans, slim[f"{c.OWN}key"] == spans["key"], "left")
    zero = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", zero("assign"), zero("access"), zero("hex"), F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("random"))


def llm_secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 7 SQL can express: the base kinds."""
    return op7_secret_scan(spark, sf_dir).drop("spans", "n_random")


def _kind_sql(n: int, kind: str) -> str:
    pattern, group, least = KINDS[kind]
    pattern = pattern.replace("'", "''")
    return f"SELECT k, '{kind}' AS kind, {n} AS place, string_split_regex(text, '{pattern}') AS b, regexp_extract_all(text, '{pattern}') AS f, regexp_extract_all(text, '{pattern}', {group}) AS g, {least} AS least FROM d"


ORACLE_SQL = {
    "llm_secret_base": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
kinds AS ({" UNION ALL ".join(_kind_sql(i, x) for i, x in enumerate(("assign", "access", "hex")))}),
found AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM kinds),
spans AS (
  SELECT k, kind, place, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS start, length(f[i]) AS n FROM found WHERE length(g[i]) >= least
), lists AS (
  SELECT k, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex, string_agg(kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT, ',' ORDER BY start, place) AS base FROM spans GROUP BY k
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256 FROM d LEFT JOIN lists USING (k)
"""
}
