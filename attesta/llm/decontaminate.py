"""Operator 13, benchmark decontamination by an FM-index per training shard.

Spark deals documents out as they are read. A task numbers the words of its documents, up to SHARD_WORDS a shard with a number of its own
after each document, and builds the shard's FM-index. All windows of the benchmark are searched backward at once, from rank
to rank in the wavelet tree; the rows that are left are located from sampled positions. Occurrences are merged to the runs of
words that they cover, which are the spans to remove. Documents aren't shuffled, and no task holds more than a batch of them.

Benchmark windows are the stated query set: their words are broadcast BLOCK_BYTES of item texts at a time, and a
pass over all documents searches a block; what earlier passes found comes along as columns. Equal windows are searched once.

Edge cases. A null text has no words, an empty one neither; a text without words has no hit. Items without words have no window. Item ids are compared as strings, rows
with one id are one item, a null id counts as the empty string. An empty benchmark leaves all documents clean, an empty table gives none. Texts of more words than
a shard are indexed in pieces that overlap by a window less one word. Repeated rows, null or repeated document ids are each judged on their own. Columns that the operator
adds begin with `__attesta_`; others are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm import common as c
from attesta.llm.fm_index import FMIndex

WINDOW = 10
#: Words that one index holds, about.
SHARD_WORDS = 1 << 20
#: Bytes of item texts whose windows are broadcast at once.
BLOCK_BYTES = 4 << 20
#: Bytes of a text that belong to words, letters in lower case; all others are spaces.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")

WORDS, HITS, SPANS, ITEMS = (f"{c.OWN}{x}" for x in ("words", "hits", "spans", "items"))
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


class _Words(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Windows:
    """Different windows of some items: `rows` of word numbers, filled up by -1 on the left, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        number, rows, owners = _Words(), [np.empty((0, window), np.int32)], [np.empty(0, np.int64)]
        self.names = sorted({x for x, _ in items}, key=lambda x: x.encode())
        place = {x: i for i, x in enumerate(self.names)}
        for name, text in items:
            ids = np.array([number[w] for w in text.translate(_LOWER).split()], np.int32)
            if len(ids):
                ids = np.concatenate((np.full(max(0, window - len(ids)), -1, np.int32), ids))
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
                owners.append(np.full(len(rows[-1]), place[name]))
        self.words = list(number)
        self.rows, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        own = np.unique(np.stack((of.reshape(-1), np.concatenate(owners))), axis=1) if len(of) else np.empty((2, 0), np.int64)
        self.owners, self.first = own[1], np.searchsorted(own[0], np.arange(len(self.rows) + 1))


def occurrences(shard: list[np.ndarray], vocabulary: dict[bytes, int], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first word within it, words, window) of each occurrence of a window in the pieces of a shard, from its index."""
    n = len(shard)
    # Each piece ends in a number of its own, so that no window lies across, and copies are told apart where they end.
    s = np.concatenate([x for i, ids in enumerate(shard) for x in (ids + n, np.array([i], ids.dtype))]).astype(np.int64)
    known = np.array([vocabulary.get(w, -2 - n) for w in windows.words] + [-1 - n]) + n
    patterns = known[windows.rows]
    possible = np.flatnonzero((patterns != -2).all(axis=1))
    patterns = patterns[possible]
    if not len(possible):
        return (np.empty(0, np.int64),) * 4
    index = FMIndex(s, n + len(vocabulary))
    low, high = index.search(patterns)
    found = high - low
    which = np.repeat(np.arange(len(patterns)), found)
    rows = np.repeat(low, found) + np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found)
    at = index.locate(rows)
    starts = np.cumsum([0] + [len(x) + 1 for x in shard[:-1]])
    piece = np.searchsorted(starts, at, "right") - 1
    return piece, at - starts[piece], (patterns >= 0).sum(axis=1)[which], possible[which]


def _pieces(texts: list[bytes | None], size: int, window: int) -> Iterator[tuple[list[tuple[int, int, np.ndarray]], dict[bytes, int]]]:
    """Shards: (text, first word, word numbers) of each piece, and the numbers of the words."""
    shard, number, held = [], _Words(), 0
    for row, text in enumerate(texts):
        words = text.translate(_LOWER).split() if text else []
        for at in range(0, len(words), size):
            part = words[at : at + size + window - 1] if len(words) > size else words
            if held and held + len(part) > size + window:
                yield shard, number
                shard, number, held = [], _Words(), 0
            shard.append((row, at, np.fromiter(map(number.__getitem__, part), np.int32, len(part))))
            held += len(part)
    if shard:
        yield shard, number


def hits_of(texts: list[bytes | None], windows: Windows, size: int, window: int) -> tuple[list[int], dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Words of each text; of those that are hit, the runs of words covered (start, stop) and the items."""
    n_words, runs, items = [0] * len(texts), {}, {}
    for shard, number in _pieces(texts, size, window):
        for row, at, ids in shard:
            n_words[row] = max(n_words[row], at + len(ids))
        piece, first, length, of = occurrences([x[2] for x in shard], number, windows)
        if not len(piece):
            continue
        row, offset = (np.array([x[i] for x in shard])[piece] for i in (0, 1))
        for r, a, z in np.unique(np.stack((row, offset + first, offset + first + length)), axis=1).T.tolist():
            runs.setdefault(r, []).append((a, z))
        row, of = np.unique(np.stack((row, of)), axis=1)
        n = windows.first[of + 1] - windows.first[of]
        own = np.repeat(windows.first[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for r, item in np.unique(np.stack((np.repeat(row, n), windows.owners[own])), axis=1).T.tolist():
            items.setdefault(r, set()).add(windows.names[item])
    return n_words, {r: merged(x) for r, x in runs.items()}, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that meet as one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def code_points(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as spans of code points: from the first word's start to the last one's end."""
    if not runs:
        return []
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    begins = np.concatenate(([0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)))
    return [(int(begins[places[a][0]]), int(begins[places[z - 1][1]])) for a, z in runs]


def _search(docs: DataFrame, text_col: str, windows: Broadcast[Windows], size: int, window: int) -> DataFrame:
    """`docs` with what a block of windows finds, added to what earlier passes found."""
    kept = [f for f in docs.schema.fields if f.name not in (WORDS, HITS, SPANS, ITEMS)]
    again = len(kept) < len(docs.columns)
    added = [T.StructField(WORDS, T.LongType()), T.StructField(HITS, _SPANS), T.StructField(SPANS, _SPANS), T.StructField(ITEMS, T.ArrayType(T.StringType()))]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    place = [f.name for f in kept].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place).cast(pa.binary()).to_pylist()
            n_words, runs, items = hits_of(texts, windows.value, size, window)
            if again:
                hits, own = (b.column(b.schema.get_field_index(x)).to_pylist() for x in (HITS, ITEMS))
                for r, (before, names) in enumerate(zip(hits, own, strict=True)):
                    if before:
                        runs[r], items[r] = merged([*runs.get(r, []), *((x["start"], x["stop"]) for x in before)]), items.get(r, set()) | set(names)
            points = {r: code_points(texts[r], x) for r, x in runs.items()}
            lists = [pa.array([[{"start": a, "stop": z} for a, z in x.get(r, [])] for r in range(len(texts))], spans) for x in (runs, points)]
            names = pa.array([sorted(items.get(r, ()), key=lambda x: x.encode()) for r in range(len(texts))], pa.list_(pa.string()))
            columns = [b.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), *lists, names], names=[*(f.name for f in kept), WORDS, HITS, SPANS, ITEMS])

    return docs.mapInArrow(run, T.StructType([*kept, *added]))


def _blocks(items: Iterator[Row], most: int) -> Iterator[list[tuple[str, bytes]]]:
    block, size = [], 0
    for name, text in items:
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((name, bytes(text)))
        size += len(text)
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`docs` with columns __attesta_words (number), __attesta_hits and __attesta_spans (what benchmark windows cover, in words and in code points, each start to stop) and __attesta_items (sorted)."""
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(item_text_col).cast("binary"))
    out, held = docs, None
    for i, block in enumerate(_blocks(items.toLocalIterator(), block_bytes)):
        # The pass before is written, so that its input may go.
        before, held = held, c.written(out, "decontaminate") if i else None
        if before is not None:
            c.drop_written(before)
        out = _search(held if i else docs, text_col, docs.sparkSession.sparkContext.broadcast(Windows(block, window)), shard_words, window)
    return out


def without_spans(text: Column, spans: Column) -> Column:
    """The text without some spans of code points, sorted and apart."""
    stop = lambda j: F.coalesce(F.get(spans, j)["stop"], F.lit(0))
    pieces = F.transform(spans, lambda s, j: F.substring(text, (stop(j - 1) + 1).cast("int"), (s["start"] - stop(j - 1)).cast("int")))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), F.substring(text, (F.element_at(spans, -1)["stop"] + 1).cast("int"), F.length(text)))).otherwise(text)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(c.documents(spark, sf_dir).select("doc_id", "text"), c.documents(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(HITS, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "doc_id", F.col(WORDS).alias("n_words"), n_hit.alias("n_hit"), F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(ITEMS, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE_SQL = {
    "op13_decontaminate": rf"""
WITH doc_words AS (
  SELECT rowid AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents)
), item_words AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS m, array_to_string(w[i + 1 : i + {WINDOW}], ' ') AS g
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT m FROM windows
), grams AS (
  SELECT d, i, m, array_to_string(w[i + 1 : i + m], ' ') AS g FROM (SELECT d, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM doc_words, sizes WHERE len(w) >= m)
), found AS (
  SELECT DISTINCT d, i, m, item FROM grams JOIN windows USING (m, g)
), hit AS (
  SELECT d, count(DISTINCT i + o) AS n_hit FROM (SELECT d, i, unnest(range(0, m)) AS o FROM found) GROUP BY d
), items AS (
  SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT d, item FROM found) GROUP BY d
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (d) LEFT JOIN items USING (d)
"""
}
