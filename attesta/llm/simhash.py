"""Operator 4, SimHash near-duplicates by pigeonhole blocks.

Each text gets a 64-bit fingerprint of its word shingles. Fingerprints are cut into blocks: of b
blocks, two fingerprints that differ in at most d bits agree in some b - d, so that each
fingerprint is put under a key for every choice of b - d blocks, keys are joined and the Hamming
distance is verified. b grows with the number of different fingerprints, so that few unrelated
ones meet under a key; the links found are the same for any b.

Only different fingerprints are joined: copies cost one row. A key that more than HOT fingerprints
share (a dense cloud of near copies) isn't joined. Its fingerprints are put under every point
within d / 2 bits of them instead: two fingerprints are within d bits of each other if, and only
if, they share such a point, and it suffices to link each to the least that has the point. That is
exact and linear in the cloud's size.

`one_of_each` asks for a similarity of shingles rather than for a distance of fingerprints: candidates share a band of
minhashes of their shingles, and are verified from the texts. On request it groups by linked fingerprints as well.

Components come from large-star and small-star steps over written tables.

Edge cases. A null text counts as empty; texts without words have fingerprint zero and link like
others. Null ids don't count for the least id of a component unless all are null. Repeated rows
are returned as often as they come. Other columns of the input are kept.
"""

from __future__ import annotations

import itertools
import math
from functools import partial, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import common as c

SEED = 42
BITS = 64
#: Fingerprints under one key beyond which its pairs are not joined.
HOT = 256
#: Unrelated fingerprints that a fingerprint may meet under all its keys, on average.
MOST_MET = 4.0
_CHUNK = 1 << 16
#: The same for bands of minhashes, whose pairs are verified from the texts.
CLOUD = 32
#: Bands, and minhashes of each: two texts of similarity 0.8 share one but for 7 in 100,000, and of 0.3 one in 17.
BANDS, BAND_ROWS = 24, 5
#: Smaller groups that a text of a larger one goes to, and further minhashes of each: 2 * 0.8 ** 3 is 1.02.
CHILDREN, MORE = 2, 3
_XORS, _ODDS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
_ODDS |= np.uint64(1)
_STEP = 1 << 11
#: Keys of texts that are broadcast rather than shuffling texts to them, at most.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: str | None, words: int, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text, as a signed number.

    bytes.lower and bytes.split know ASCII alone: A-Z, and the white space of the word definition.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    k = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _CHUNK):
        h = np.array([digest(joined[a:b]) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def shingles(text: str | None, words: int) -> np.ndarray:
    """64-bit hashes of a text's different word shingles."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    k = min(words, len(found))
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(found[i : i + k])) for i in range(len(found) - k + 1)] if found else [], np.uint64)).view(np.int64)


def bands(found: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bands of a text's shingles; texts without shingles share all of theirs."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), _STEP):
        least = np.minimum(least, ((found[at : at + _STEP, None].view(np.uint64) ^ _XORS) * _ODDS).min(axis=0))
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64).view(np.int64)


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = 4, name: str = "fingerprint") -> DataFrame:
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn(name, simhash(F.coalesce(F.col(text_col), F.lit(""))))


def blocks_for(n: int, most_bits: int) -> int:
    """The least number of blocks that keeps chance meetings few among n fingerprints."""
    for b in range(most_bits + 1, 4 * most_bits + 2):
        if math.comb(b, most_bits) * n / 2.0 ** (BITS * (b - most_bits) / b) <= MOST_MET:
            return b
    return 4 * most_bits + 1


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def keys(fps: DataFrame, most_bits: int, blocks: int) -> DataFrame:
    """(fp, key): one row for each choice of blocks that may agree."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    chosen = [reduce(int.__or__, x) for x in itertools.combinations(masks, blocks - most_bits)]
    all_ = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(chosen)])
    return fps.select("fp", F.explode(all_).alias("key"))


def links(fps: DataFrame, most_bits: int, hot_size: int | None = None) -> DataFrame:
    """(a, b), a > b: links between different fingerprints (column fp) whose closure is that of all links."""
    n, hot_size = fps.count(), hot_size or HOT
    rows = c.written(keys(fps, most_bits, blocks_for(n, most_bits)), "simhash-keys")
    shared = c.written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1), "simhash-shared")
    some = rows.join(shared, "key")
    cool = some.where(F.col("n") <= hot_size).select("key", "fp")
    other = cool.select("key", F.col("fp").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = cool.withColumnRenamed("fp", "a").join(other, "key").where((F.col("a") > F.col("b")) & (apart <= most_bits)).select("a", "b")
    hot = some.where(F.col("n") > hot_size).select("fp").distinct()
    out = c.written(near.unionByName(_through_points(hot, most_bits)).distinct(), "simhash-links")
    c.drop_written(rows, shared)
    return out


def _through_points(hot: DataFrame, most_bits: int) -> DataFrame:
    """Links by shared points: the balls of d / 2 bits around two fingerprints meet if, and only if, they are within d bits."""
    if most_bits % 2:
        raise ValueError("most_bits must be even")
    # No bit or any one of them is flipped, d / 2 times over.
    ball = F.array(F.col("fp"))
    for _ in range(most_bits // 2):
        ball = F.array_distinct(F.flatten(F.transform(ball, lambda x: F.transform(F.sequence(F.lit(0), F.lit(BITS)), lambda i: F.when(i == BITS, x).otherwise(x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))))))
    points = hot.select("fp", F.explode(ball).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where(F.col("n") > 1).select("point", "b")
    return points.join(least, "point").where(F.col("fp") > F.col("b")).select(F.col("fp").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b): the least node of its component."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = c.written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    seen = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        old, edges = edges, c.written(small.where(F.col("a") != F.col("b")).distinct(), "star")
        c.drop_written(old)
        now = state(edges)
        if now == seen:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._attesta_path = edges._attesta_path
            return out
        seen = now


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, most_bits: int = 4) -> DataFrame:
    """`docs` without its text, with __attesta_ columns fingerprint, root (the component's least fingerprint) and component (the least id that is reachable)."""
    fp = f"{c.OWN}fingerprint"
    d = c.written(with_fingerprint(docs, text_col, words, fp).drop(text_col), "simhash")
    fps = c.written(d.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("first")), "simhash-fps")
    edges = links(fps.select("fp"), most_bits)
    roots = components(edges)
    c.drop_written(edges)
    with_root = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = with_root.groupBy("root").agg(F.min("first").alias(f"{c.OWN}component"))
    of = with_root.join(firsts, "root").select(F.col("fp").alias(fp), F.col("root").alias(f"{c.OWN}root"), f"{c.OWN}component")
    return d.join(of, fp)


def similar(docs: DataFrame, text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, root): content keys of texts with others that are as similar, and the least key of their group.

    Candidates are texts that share a band of minhashes of their word shingles; the Jaccard similarity of each pair's
    shingles is then computed from the whole texts. Under a band that more than CLOUD texts share, all are compared with
    one of them first, another one for each band; bands whose texts are not in one group yet are split by further minhashes.
    """
    key = c.text_key(F.col(text_col))
    texts = docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))

    @F.pandas_udf("array<long>")
    def marks(bodies: pd.Series) -> pd.Series:
        return pd.Series([bands(shingles(t, words)) for t in bodies])

    @F.pandas_udf("array<long>")
    def parts(bodies: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words) for t in bodies])

    marked = c.written(texts.select("key", marks("body").alias("bands")).groupBy("key").agg(F.first("bands").alias("bands")), "similar-marks")
    shared = c.written(marked.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1), "similar-shared")
    rows = c.written(marked.select("key", F.explode("bands").alias("band")).join(c.sized_broadcast(shared, BROADCAST_ROWS), "band"), "similar-rows")
    cool, hot = rows.where(F.col("n") <= CLOUD), rows.where(F.col("n") > CLOUD)
    pairs = cool.select("band", F.col("key").alias("x")).join(cool.select("band", F.col("key").alias("y")), "band").where(F.col("x") > F.col("y")).select("x", "y")
    heads = hot.groupBy("band").agg(F.min_by("key", F.xxhash64("key", "band")).alias("y"))
    star = hot.select("band", F.col("key").alias("x")).join(heads, "band").where(F.col("x") != F.col("y"))
    pairs = c.written(pairs.unionByName(star.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))).distinct(), "similar-pairs")
    needed = c.written(pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct(), "similar-keys")
    found = texts.join(c.sized_broadcast(needed, BROADCAST_ROWS), "key", "left_semi").select("key", parts("body").alias("s"))
    found = c.written(found.groupBy("key").agg(F.first("s").alias("s")), "similar-shingles")
    compared = pairs.join(found.select(F.col("key").alias("x"), F.col("s").alias("s")), "x").join(found.select(F.col("key").alias("y"), F.col("s").alias("t")), "y")
    roots = components(compared.where(_alike("s", "t", similarity)).select(F.col("x").alias("a"), F.col("y").alias("b")))
    roots = _refined(hot.select(F.col("band").alias("group"), "key"), roots, found, similarity)
    c.drop_written(marked, shared, rows, pairs, needed, found)
    return roots.select(F.hex("node").alias("key"), F.hex("root").alias("root"))


def _alike(s: str, t: str, similarity: float) -> Column:
    """Whether two arrays of shingles have a Jaccard similarity of that much, if not more."""
    return F.size(F.array_intersect(s, t)) * (1 + similarity) + 1e-9 >= similarity * (F.size(s) + F.size(t))


def children(group: int, found: np.ndarray) -> list[int]:
    """Keys of the CHILDREN groups that a text goes to from a group: of MORE further minhashes each, by functions of the group's own."""
    digest = partial(xxhash.xxh3_64_intdigest, int(group).to_bytes(8, "little", signed=True))
    n = CHILDREN * MORE
    xors, odds = (np.array([[digest(seed=i)] for i in range(at, at + n)], np.uint64) for at in (0, n))
    least = np.full(n, np.iinfo(np.uint64).max)
    for at in range(0, len(found), _STEP):
        least = np.minimum(least, ((found[None, at : at + _STEP].view(np.uint64) ^ xors) * (odds | np.uint64(1))).min(axis=1))
    return [_signed(digest(seed=xxhash.xxh3_64_intdigest(x.tobytes(), i))) for i, x in enumerate(least.reshape(CHILDREN, MORE))]


def _refined(rows: DataFrame, roots: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """`roots` (node, root) with the links among the texts of hot groups; `rows` has (group, key), `found` (key, s).

    A group whose texts have one root is done. Each text of another goes to CHILDREN smaller groups, each of those that
    agree in MORE further minhashes. In groups of up to CLOUD texts pairs of different roots are compared, in larger ones
    each text with one of them, and these are split again. Pairs of similarity 0.8 stay together in 1.02 of the smaller groups
    on average, so that depth costs few of them; texts less alike than that to the rest of their group leave it, so that
    groups shrink while the number of rows of a level doesn't grow.
    """

    @F.pandas_udf("array<long>")
    def split(groups: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([[x for g in gs for x in children(g, np.asarray(s, np.int64))] for gs, s in zip(groups, parts, strict=True)])

    while True:
        rooted = rows.join(roots, rows["key"] == roots["node"], "left").select("group", "key", F.coalesce("root", "key").alias("root"))
        several = rooted.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi")).select("group")
        several = c.written(several, "similar-several")
        members = rooted.join(c.sized_broadcast(several, BROADCAST_ROWS), "group").groupBy("key", "root").agg(F.collect_list("group").alias("groups"))
        below = members.join(found, "key").select("key", "root", F.size("s").alias("m"), F.explode(F.array_distinct(split("groups", "s"))).alias("group"))
        below = c.written(below, "similar-below")
        c.drop_written(several, rows)
        if below.isEmpty():
            c.drop_written(below)
            return roots
        head = F.min_by(F.struct("key", "root", "m"), F.xxhash64("key", "group")).alias("y")
        sizes = below.groupBy("group").agg(F.count("*").alias("n"), head, F.min("root").alias("lo"), F.max("root").alias("hi"))
        sizes = c.written(sizes.where(F.col("lo") != F.col("hi")).select("group", "n", "y"), "similar-sizes")
        placed = below.join(c.sized_broadcast(sizes, BROADCAST_ROWS, F.lit(128)), "group").select("group", "n", F.struct("key", "root", "m").alias("x"), "y")
        cool, hot = placed.where(F.col("n") <= CLOUD), placed.where(F.col("n") > CLOUD)
        near = (F.col("x.root") != F.col("y.root")) & (F.least("x.m", "y.m") + 1e-9 >= similarity * F.greatest("x.m", "y.m"))
        pairs = cool.select("group", "x").join(cool.select("group", F.col("x").alias("y")), "group").where(near & (F.col("x.key") > F.col("y.key"))).select("x", "y")
        pairs = pairs.unionByName(hot.where(near).select("x", "y"))
        pairs = pairs.select(*[F.col(f"{a}.{x}").alias(f"{a}_{x}") for a in "xy" for x in ("key", "root")]).distinct()
        compared = pairs.join(found.select(F.col("key").alias("x_key"), "s"), "x_key").join(found.select(F.col("key").alias("y_key"), F.col("s").alias("t")), "y_key")
        links = c.written(compared.where(_alike("s", "t", similarity)).select(F.col("x_root").alias("a"), F.col("y_root").alias("b")).distinct(), "similar-across")
        rows = c.written(hot.select("group", "x.key"), "similar-rows")
        if not links.isEmpty():
            merged = components(links)
            moved = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            before, roots = (roots, merged), c.written(moved.unionByName(merged), "similar-roots")
            c.drop_written(*before)
        c.drop_written(links, below, sizes)


def near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, most_bits: int = 4) -> DataFrame:
    """(key, root): content keys of different texts whose fingerprints are linked, as `group` links them, and the least key of their group."""
    key = f"{c.OWN}key"
    rows = docs.select(id_col, text_col, F.hex(c.text_key(F.col(text_col))).alias(key))
    linked = group(rows, id_col, text_col, words, most_bits).select(F.col(key).alias("key"), F.col(f"{c.OWN}root").alias("group")).distinct()
    linked = c.written(linked, "near-texts")
    heads = linked.groupBy("group").agg(F.min("key").alias("root"), F.count("*").alias("n")).where(F.col("n") > 1).select("group", "root")
    return linked.join(heads, "group").select("key", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, most_bits: int | None = None) -> DataFrame:
    """`docs` with one row of each group of equal and similar texts: the least by id (null last), then by content.

    With `most_bits` texts whose fingerprints are linked are of one group too.
    """
    roots = c.written(similar(docs, text_col, words, similarity), "similar-roots")
    if most_bits is not None:
        fingerprints = near(docs, id_col, text_col, most_bits=most_bits)
        edges = c.written(roots.unionByName(fingerprints).select(F.col("key").alias("a"), F.col("root").alias("b")), "near-links")
        c.drop_written(roots)
        roots = components(edges).select(F.col("node").alias("key"), "root")
        c.drop_written(edges)
    own = docs.select(F.col(id_col).alias("id"), F.hex(c.text_key(F.col(text_col))).alias("key"))
    own = own.join(c.sized_broadcast(roots, BROADCAST_ROWS), "key", "left").withColumn("root", F.coalesce("root", "key"))
    place = F.struct(F.col("id").isNull().alias("null"), "id", "key")
    firsts = c.written(own.groupBy("root").agg(F.min(place).alias("p")).select("p.id", "p.key"), "similar-kept")
    key = f"{c.OWN}key"
    rows = docs.withColumn(key, F.hex(c.text_key(F.col(text_col))))
    kept = rows.join(firsts.select(F.col("id").alias(f"{c.OWN}id"), F.col("key").alias(f"{c.OWN}first")), (F.col(key) == F.col(f"{c.OWN}first")) & F.col(id_col).eqNullSafe(F.col(f"{c.OWN}id")), "left_semi")
    return kept.dropDuplicates([key, id_col]).select(*docs.columns)


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group(c.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex(f"{c.OWN}fingerprint")), 16, "0").alias("fingerprint"), F.col(f"{c.OWN}component").alias("component_id"))
