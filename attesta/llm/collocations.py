"""Operator 11, phrase collocations from weighted n-gram counts.

Texts are cut into pieces, and equal pieces of a language become one row with their number: what repeats is counted once, with its weight. N-grams are
counted level by level. A task counts those of its pieces in duckdb, out of core; the sums are dealt to buckets by hash of language and phrase, and duckdb adds up
each bucket. No phrase sends more rows than there are tasks, however often it occurs. Phrases under the least count go, as
no candidate has them, whole or as a part.

A phrase can only reach the least count if its words, and its parts of one word less, do. So each level marks what it keeps in a bitmap of
fixed size by hash, and the next level passes over phrases whose parts have no mark. Equal hashes only let more phrases be counted: results don't
depend on it, nor does memory on the corpus.

Candidates ask for their parts: each cut sends a request for either side to the bucket of that phrase, where it meets the count, and answers are
grouped by candidate again. Adaptive execution splits a part that many candidates ask for. Scores are whole numbers of up to 38 digits, so that
counts of 10^15 are exact. Longer candidates send their count to the phrases within them the same way.

Edge cases. A null text counts as empty; a text or piece without words has no phrases. A null language is `und`, together with one that is called so. Repeated rows
and ids count each time. Very long texts and pieces are counted whole. Ties are broken by count and phrase, so that ranks are
the same in every run. Languages without candidates, and an empty table, give no rows. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm import common as c

LEAST, WORDS, TOP = 10, 3, 2000
UNKNOWN = "und"
#: Bits of the bitmap of phrases that reach the least count, as a power of two, and the bits of a block of it.
BITS, BLOCK_BITS = 26, 16
#: Memory of duckdb in a task; beyond it, it goes to disk.
MEMORY = "256MB"
#: Parts that a language's candidates are ranked in first.
SALTS = 64

_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
_COUNTED_SQL = "lang string, phrase string, f long"


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, times): the words of each different piece, separated by single spaces, and how often it occurs."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), upper, upper.lower())
    text = F.regexp_replace(text, "\t[ \t]*| [ \t]+", " ")
    cut = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.explode(F.split(text, "[.,;:!?\n-\r]", -1)).alias("piece"))
    return cut.withColumn("piece", F.trim("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("times"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up counts by language and phrase in duckdb, which spills to a folder of the task's own."""
    with tempfile.TemporaryDirectory() as folder, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False}) as db:
        counted = pa.RecordBatchReader.from_batches(_COUNTED, batches)
        db.register("counted", counted)
        yield from db.sql("SELECT lang, phrase, sum(f)::BIGINT AS f FROM counted GROUP BY ALL").to_arrow_reader(50_000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word, each different word of the batch hashed once."""
    d = words.dictionary_encode()
    return np.array([xxhash.xxh64_intdigest(w) for w in d.dictionary.cast(pa.binary()).to_pylist()], np.uint64)[d.indices.to_numpy()]


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of what comes before and its last word."""
    return _mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def _bit(phrase: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return (_mixed(phrase + lang * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)).astype(np.int64)


def _phrase_bits(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    lists = pc.split_pattern(phrases, " ")
    words, ends = _hashes(lists.flatten()), lists.offsets.to_numpy()
    h, n = words[ends[:-1]], np.diff(ends)
    for k in range(1, n.max()):
        on = n > k
        h[on] = _joined(h[on], words[ends[:-1][on] + k])
    return _bit(h, _hashes(langs))


class Marks:
    """Bitmap of phrases that reach the least count."""

    def __init__(self, blocks: list[tuple[int, bytes]]) -> None:
        self.bytes = np.zeros(1 << (BITS - 3), np.uint8)
        for block, own in blocks:
            at = block << (BLOCK_BITS - 3)
            self.bytes[at : at + len(own)] = np.frombuffer(own, np.uint8)

    def __getitem__(self, bit: np.ndarray) -> np.ndarray:
        return self.bytes[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 != 0


def marks(counts: DataFrame) -> Marks:
    """The marks of some phrases; of whatever many, 2^BITS bits come to the driver at most."""
    size = 1 << (BLOCK_BITS - 3)
    schema = pa.schema([("block", pa.int32()), ("bits", pa.binary())])

    def emitted(bitmap: np.ndarray) -> pa.RecordBatch:
        whole = bitmap.reshape(-1, size)
        at = np.flatnonzero(whole.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([whole[i].tobytes() for i in at], pa.binary())], schema=schema)

    def of_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << (BITS - 3), np.uint8)
        for b in batches:
            if b.num_rows:
                bit = _phrase_bits(b.column(0), b.column(1))
                np.bitwise_or.at(bitmap, bit >> 3, np.uint8(1) << (bit & 7).astype(np.uint8))
        yield emitted(bitmap)

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << (BITS - 3), np.uint8)
        for b in batches:
            for block, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bitmap[block * size : (block + 1) * size] |= np.frombuffer(own, np.uint8)
        yield emitted(bitmap)

    kind = "block int, bits binary"
    return Marks([(r["block"], bytes(r["bits"])) for r in counts.select("lang", "phrase").mapInArrow(of_phrases, kind).repartition("block").mapInArrow(of_blocks, kind).toLocalIterator()])


def level(parts: DataFrame, n: int, least: int, shorter: Broadcast[Marks] | None) -> DataFrame:
    """(lang, phrase, f) of all phrases of n words that occur `least` times; `shorter` marks those of n - 1 words."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pc.split_pattern(b.column(1), " ")
            words, ends = lists.flatten(), lists.offsets.to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            at = np.arange(len(words))
            if n > 1:
                h = words_hash = _hashes(words)
                for k in range(1, n - 1):
                    h = _joined(h[:-1], words_hash[k:])
                marked = shorter.value[_bit(h, _hashes(b.column(0))[row[: len(h)]])]
                # Both parts of n - 1 words have a mark, and the last word is of the same piece.
                at = np.flatnonzero(marked[:-1] & marked[1:] & (row[: len(h) - 1] == row[n - 1 :]))
            phrase = pc.binary_join_element_wise(*[words.take(pa.array(at + k)) for k in range(n)], " ") if n > 1 else words
            own = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), phrase, b.column(2).take(own)], schema=_COUNTED)

    counted = parts.select("lang", "piece", "times").mapInArrow(lambda batches: _summed(grams(batches)), _COUNTED_SQL)
    return counted.repartition("lang", "phrase").mapInArrow(_summed, _COUNTED_SQL).where(F.col("f") >= least)


def counts(parts: DataFrame, most_words: int = WORDS, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of up to `most_words` words that occur `least` times or more."""
    found, shorter = None, None
    for n in range(1, most_words + 1):
        here = c.written(level(parts, n, least, shorter), f"collocations-{n}")
        if n < most_words:
            shorter = parts.sparkSession.sparkContext.broadcast(marks(here))
        here = here.withColumn("words", F.lit(n))
        found = here if found is None else found.unionByName(here)
    return found


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a a / (l r)) in whole numbers; exact for counts up to 10^15."""
    d = lambda x: x.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (d(a) * d(a)), d(left) * d(right))


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of each candidate, at its lowest cut."""
    candidates = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    requests = candidates.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit("l").alias("side"), F.slice("w", F.lit(1), F.col("k")).alias("w")), F.struct(F.lit("r").alias("side"), F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("w")))
    requests = requests.select("lang", "phrase", "words", "a", "k", F.explode(sides).alias("of"))
    requests = requests.select("lang", F.array_join("of.w", " ").alias("part"), "phrase", "words", "a", "k", "of.side")
    answers = requests.join(found.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f"))).alias(side)
    cuts = answers.groupBy("lang", "phrase", "words", "a", "k").agg(of("l"), of("r")).withColumn("score", cut_score(F.col("a"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def contained(found: DataFrame) -> DataFrame:
    """(lang, phrase, longest): for each candidate within longer ones, the greatest count of those."""
    longer = found.where("words > 2").withColumn("w", F.split("phrase", " "))
    sizes = F.sequence(F.lit(2), F.col("words") - 1)
    within = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    return longer.select("lang", F.explode(F.array_distinct(within)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language by score, count and phrase, with `rank`. Languages are ranked in parts first, so that no task sorts one whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    firsts = parts.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return firsts.drop("salt").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = WORDS, least: int = LEAST, top: int = TOP, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, words, a, l, r, n, score): phrases of two words or more; those go that lie in a longer candidate with `share` percent of their count."""
    parts = c.written(pieces(docs, text_col, lang_col), "collocations-pieces")
    found = counts(parts, most_words, least)
    size = F.length("piece") - F.length(F.translate("piece", " ", "")) + 1
    totals = parts.groupBy("lang").agg(F.sum(size.cast("long") * F.col("times")).alias("n"))
    best = scored(found).join(contained(found), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longest") < share * F.col("a"), F.lit(True)))
    return ranked(best, top).join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(c.documents(spark, sf_dir).select("text", "lang")).drop("words")


ORACLE_SQL = {
    "op11_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, m, w[i + 1 : i + m] AS p FROM (SELECT lang, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM words, range(1, {WORDS + 1}) r(m) WHERE len(w) >= m)
), f AS (
  SELECT lang, m, array_to_string(p, ' ') AS phrase, any_value(p) AS p, count(*)::HUGEINT AS f FROM grams GROUP BY lang, m, phrase
), cand AS (
  SELECT * FROM f WHERE m > 1 AND f >= {LEAST}
), parts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(p[1:k], ' ') AS lp, array_to_string(p[k + 1 :], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)
), cuts AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, (1000000 * a * a) // (l.f * r.f) AS score
  FROM parts c JOIN f l ON l.lang = c.lang AND l.phrase = lp JOIN f r ON r.lang = c.lang AND r.phrase = rp
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, f, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase FROM cand WHERE m = 3
), gone AS (
  SELECT DISTINCT s.lang, s.phrase FROM cand s JOIN inner_ g ON g.lang = s.lang AND g.phrase = s.phrase WHERE 100 * g.f >= 50 * s.f
), kept AS (
  SELECT best.* FROM best ANTI JOIN gone ON gone.lang = best.lang AND gone.phrase = best.phrase
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
}
