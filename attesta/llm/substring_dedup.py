"""Operator 3, exact substring dedup by prefix-free parsing.

A byte is removed if a LENGTH-byte string over it starts at any other place of the corpus too.

Parsing. A rolling hash over GRAM bytes triggers: of each WINDOW hashes the least, the first of equal
ones, is the anchor of the string that starts where the window does. Anchors depend on the string alone, so
equal strings have equal anchors at equal distance. The starts that share an anchor form a phrase: the text from
the first of them to the end of the last one's string. Phrases overlap by LENGTH - 1 bytes, like those of a
prefix-free parse by triggers of that length, and every LENGTH-byte string lies in just one of them. Equal phrases that follow each other,
as in periodic text, are one row with their number.

Dictionary and parse. The dictionary has each different phrase once, with how often the parse has it. Its suffixes of LENGTH bytes or more can
only agree in as many bytes if their phrases share a core (the bytes from the anchor that all their strings hold), so its suffix array
is built core by core: phrases are bucketed by core, and under each core with several phrases the suffixes of all of them are sorted by
prefix doubling until LENGTH bytes are compared. Suffixes of equal rank have a common prefix of LENGTH bytes. A string is repeated if its
rank is shared, or if the parse has its phrase twice. The order of the parse's own suffixes would only order suffixes that agree in LENGTH bytes
already, which no longer matters, so it isn't made. A core with one phrase needs no order: all its strings occur as often as the phrase.

Cores of more than LOCAL phrases are first dealt to parts by the hash of each string, so that
no part grows with its core; there strings are compared by that hash of 128 bits. Everywhere else, strings are compared as bytes.

Texts are parsed once for each different content, in a table that is bucketed by content, so that texts are shuffled once.
Contents of texts are known by 128 bits of their SHA-256, phrases by 128 bits of BLAKE2.

Edge cases. A null text counts as empty; texts shorter than LENGTH lose nothing. A text that occurs
twice, be it in rows with equal ids, loses all if it has LENGTH bytes. Equal hashes in a window give the first as anchor. Very long texts are
parsed in pieces that overlap. Other columns don't matter. Nothing is capped.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import common as c

LENGTH, WINDOW, GRAM = 400, 320, 8
#: Bytes from the anchor on that all strings of an anchor hold.
CORE = LENGTH - WINDOW + 1
#: Phrases with one core that are compared in one part, on average.
LOCAL = 512
#: Cores known to repeat that are broadcast, at most; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Bytes parsed at once; a place within them takes the low bits of a hash, to order equal hashes.
_PIECE, _PLACE = 1 << 23, np.uint64((1 << 24) - 1)
_KEY = ["k1", "k2"]
_TWO = struct.Struct("<qq")


def content_key(text: Column) -> list[Column]:
    """128 bits of a text's SHA-256, as two numbers."""
    digest = F.sha2(text.cast("binary"), 256)
    number = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return [number(1).alias("k1"), number(17).alias("k2")]


def texts_table(docs: DataFrame, text_col: str) -> DataFrame:
    """(k1, k2, copies, body): each different text once, in the shared folder, bucketed by its key."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*content_key(text), text.alias("body")).groupBy(*_KEY).agg(F.count("*").alias("copies"), F.first("body").alias("body"))
    name = f"attesta_texts_{uuid.uuid4().hex}"
    path = f"{c.shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, *_KEY).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._attesta_table = (name, path)
    return out


def drop_texts(texts: DataFrame) -> None:
    name, path = texts._attesta_table
    texts.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    c._delete(texts.sparkSession, path)


def anchors(piece: bytes) -> np.ndarray:
    """The anchor of the string at each start; starts whose window would pass the end are left out."""
    b = np.frombuffer(piece, np.uint8).astype(np.uint64)
    x = np.zeros(len(b) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        x |= b[i : len(b) - GRAM + 1 + i] << np.uint64(8 * i)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x = (x & ~_PLACE) | np.arange(len(x), dtype=np.uint64)
    step = 1
    while 2 * step <= WINDOW:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    if step < WINDOW:
        x = np.minimum(x[: len(x) - (WINDOW - step)], x[WINDOW - step :])
    return (x & _PLACE).astype(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _digest(t: bytes) -> tuple[int, int]:
    return _TWO.unpack(hashlib.blake2b(t, digest_size=16).digest())


def phrases_of(texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int, int, int]]:
    """(text, first start, starts, equal phrases from here on, anchor, hash of the core, two of the content) of each phrase."""
    batch: list[tuple[int, int, bytes]] = []
    size = 0

    def parsed() -> Iterator[tuple[int, int, int, int, int, int, int, int]]:
        a = anchors(b"".join(x[2] for x in batch))
        at = 0
        for row, offset, t in batch:
            own = a[at : at + len(t) - LENGTH + 1]
            cut = np.flatnonzero(np.diff(own)) + 1
            first = np.concatenate(([0], cut))
            held: tuple | None = None
            for s, e, an in zip(first.tolist(), np.append(cut, len(own)).tolist(), (own[first] - at).tolist(), strict=True):
                # Neighbours of one content have the same anchor within them, and so the same core.
                phrase = t[s : e - 1 + LENGTH]
                if held is not None and held[0] == phrase:
                    held[1][3] += 1
                    continue
                if held is not None:
                    yield tuple(held[1])
                core = xxhash.xxh3_64_intdigest(t[an : an + CORE])
                held = phrase, [row, offset + s, e - s, 1, offset + an, _signed(core), *_digest(phrase)]
            if held is not None:
                yield tuple(held[1])
            at += len(t)

    for row, t in enumerate(texts):
        for offset in range(0, len(t) - LENGTH + 1, _PIECE):
            part = t[offset : offset + _PIECE + LENGTH - 1]
            if size and size + len(part) > _PIECE + LENGTH:
                yield from parsed()
                batch, size = [], 0
            batch.append((row, offset, part))
            size += len(part)
    if batch:
        yield from parsed()


def _batches(rows: Iterator[tuple], schema: pa.Schema, n: int = 50_000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema(list(fields.items()))


def parse(texts: DataFrame) -> DataFrame:
    """(k1, k2, copies, start, starts, run, anchor, core, c1, c2) of each phrase of the texts; `run` equal ones follow each other."""
    schema = _schema(k1=pa.int64(), k2=pa.int64(), copies=pa.int64(), start=pa.int32(), starts=pa.int32(), run=pa.int32(), anchor=pa.int32(), core=pa.int64(), c1=pa.int64(), c2=pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
                for row, *rest in phrases_of([x.encode("utf-8") for x in b.column(3).to_pylist()]):
                    yield (*keys[row], *rest)

        yield from _batches(rows(), schema)

    return texts.select(*_KEY, "copies", "body").where(F.octet_length("body") >= LENGTH).mapInArrow(run, "k1 long, k2 long, copies long, start int, starts int, run int, anchor int, core long, c1 long, c2 long")


def string_ranks(phrases: list[bytes]) -> list[np.ndarray]:
    """The rank of each LENGTH-byte string of each phrase, in the order of the suffixes of all: equal ranks are equal strings.

    By prefix doubling: ranks of suffixes by their first n bytes, in pairs, are ranks by 2 n bytes.
    """
    t = np.frombuffer(b"".join(phrases), np.uint8).astype(np.uint64)
    known = min(8, LENGTH)
    key = np.zeros(len(t) - known + 1, np.uint64)
    for i in range(known):
        key = key << np.uint64(8) | t[i : len(t) - known + 1 + i]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while known < LENGTH:
        more = min(known, LENGTH - known)
        rank = np.unique(rank[: len(rank) - more] * len(t) + rank[more:], return_inverse=True)[1].astype(np.int64)
        known += more
    ends = np.cumsum([len(p) for p in phrases])
    return [rank[e - len(p) : e - LENGTH + 1] for e, p in zip(ends.tolist(), phrases, strict=True)]


def with_strings(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """`open_` phrases, dealt to (core, part): texts stay where they are, phrases come to their buckets.

    A core of up to LOCAL phrases is one part, and its phrases come as bytes. One of more phrases has a part for each LOCAL of
    them, and a phrase sends each part the strings whose hash falls to it: places and hashes.
    """
    lists = open_.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "starts", "core", "n", "parts")).alias("phrases"))
    numbers = pa.list_(pa.int64())
    out = _schema(core=pa.int64(), part=pa.int32(), n=pa.int64(), k1=pa.int64(), k2=pa.int64(), start=pa.int32(), bytes=pa.binary(), at=pa.list_(pa.int32()), h1=numbers, h2=numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                k1, k2, body, lists = (b.column(i) for i in range(4))
                for i in range(b.num_rows):
                    t, key = body[i].as_py().encode("utf-8"), (k1[i].as_py(), k2[i].as_py())
                    for p in lists[i].as_py():
                        own = t[p["start"] : p["start"] + p["starts"] - 1 + LENGTH]
                        if p["parts"] == 1:
                            yield p["core"], 0, p["n"], *key, p["start"], own, None, None, None
                            continue
                        dealt: dict[int, tuple[list, list, list]] = {}
                        for at in range(len(own) - LENGTH + 1):
                            h1, h2 = _digest(own[at : at + LENGTH])
                            for x, y in zip(dealt.setdefault(h1 % p["parts"], ([], [], [])), (at, h1, h2), strict=True):
                                x.append(y)
                        for part, (ats, h1s, h2s) in dealt.items():
                            yield p["core"], part, p["n"], *key, p["start"], None, ats, h1s, h2s

        yield from _batches(rows(), out, 5_000)

    joined = texts.select(*_KEY, "body").join(lists, _KEY).select(*_KEY, "body", "phrases")
    return joined.mapInArrow(run, "core long, part int, n long, k1 long, k2 long, start int, bytes binary, at array<int>, h1 array<long>, h2 array<long>")


def _runs(at: list[int], start: int) -> Iterator[tuple[int, int]]:
    """Bytes covered by the strings at some starts, one span for each run of starts."""
    first = last = None
    for i in at:
        if last is not None and i == last + 1:
            last = i
            continue
        if first is not None:
            yield start + first, start + last + LENGTH
        first = last = i
    if first is not None:
        yield start + first, start + last + LENGTH


def compared(strings: DataFrame) -> DataFrame:
    """(k1, k2, start, stop): repeated strings of phrases that occur once. The phrases of a part come one after the other.

    Of phrases that came as bytes, the part's suffixes are sorted at its end. Of others, only the first place of each different string is
    held until the string comes again.
    """
    schema = _schema(k1=pa.int64(), k2=pa.int64(), start=pa.int32(), stop=pa.int32())

    def settled(held: list[tuple]) -> Iterator[tuple]:
        ranks = string_ranks([x[-1] for x in held])
        all_ = np.concatenate(ranks)
        often = np.bincount(all_, minlength=all_.max() + 1) > 1
        for (n, k1, k2, start, _), own in zip(held, ranks, strict=True):
            if n == 1:
                for span in _runs(np.flatnonzero(often[own]).tolist(), start):
                    yield k1, k2, *span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            here: tuple | None = None
            # Strings with one core repeat only at the same distance from the anchor: the hash need not hold it.
            first: dict[tuple[int, int], tuple | None] = {}
            held: list[tuple] = []
            for b in batches:
                for core, part, n, k1, k2, start, t, at, h1, h2 in zip(*(col.to_pylist() for col in b.columns), strict=True):
                    if (core, part) != here:
                        if held:
                            yield from settled(held)
                        here, first, held = (core, part), {}, []
                    if t is not None:
                        held.append((n, k1, k2, start, t))
                        continue
                    again = []
                    for i, h in zip(at, zip(h1, h2, strict=True), strict=True):
                        if h not in first:
                            first[h] = (k1, k2, start + i) if n == 1 else None
                            continue
                        before = first[h]
                        if before is not None:
                            yield *before, before[2] + LENGTH
                            first[h] = None
                        again.append(i)
                    if n == 1:
                        for span in _runs(again, start):
                            yield k1, k2, *span
            if held:
                yield from settled(held)

        yield from _batches(rows(), schema)

    dealt = strings.repartition("core", "part").sortWithinPartitions("core", "part")
    return dealt.mapInArrow(run, "k1 long, k2 long, start int, stop int")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(k1, k2, spans: sorted array of {start, stop} that may overlap) of texts that occur once; `texts` as from `texts_table`."""
    parsed = c.written(parse(texts), "substring-phrases")
    times, content = F.sum(F.col("copies") * F.col("run")).alias("n"), F.struct("c1", "c2")
    cores = parsed.groupBy("core").agg(times, (F.min(content) != F.max(content)).alias("open")).where(F.col("n") > 1).select("core", "open")
    cores = c.written(cores, "substring-cores")
    shared = parsed.join(c.sized_broadcast(cores, BROADCAST_ROWS), "core")
    settled = shared.where(~F.col("open") & (F.col("copies") == 1))
    several = c.written(shared.where("open").drop("open"), "substring-open")
    contents = several.groupBy("core", "c1", "c2").agg(times, *[F.first(x).alias(x) for x in (*_KEY, "start", "starts")])
    contents = c.written(contents, "substring-contents")
    whole = several.where(F.col("copies") == 1).join(contents.where(F.col("n") > 1).select("core", "c1", "c2"), ["core", "c1", "c2"])
    groups = contents.groupBy("core").agg(F.count("*").alias("group"), F.min("n").alias("least")).where((F.col("group") > 1) & (F.col("least") == 1)).select("core", "group")
    opened = contents.join(groups, "core").withColumn("parts", F.ceil(F.col("group") / LOCAL).cast("int"))
    all_ = compared(with_strings(opened, texts))
    for x in (settled, whole):
        all_ = all_.unionByName(x.select(*_KEY, "start", (F.col("start") + F.col("starts") * F.col("run") - 1 + LENGTH).alias("stop")))
    out = c.written(all_.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans")), "substring-spans")
    c.drop_written(parsed, cores, several, contents)
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the spans, and the spans merged."""
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    edges = [0, *(x for m in merged for x in m), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), [(a, b) for a, b in merged]


def dedup(docs: DataFrame, text_col: str = "text", digest: bool = False) -> DataFrame:
    """(k1, k2, n_bytes, spans, kept) of each different text; with `digest`, kept is the hexadecimal SHA-256 of what is kept."""
    texts = texts_table(docs, text_col)
    spans = repeated_spans(texts)
    joined = texts.join(spans, _KEY, "left").select(*_KEY, "copies", "body", "spans")
    kind = pa.string() if digest else pa.binary()
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                k1, k2, copies, body, spans = (b.column(i) for i in range(5))
                for i in range(b.num_rows):
                    t = body[i].as_py().encode("utf-8")
                    if copies[i].as_py() > 1 and len(t) >= LENGTH:
                        found = [(0, len(t))]
                    else:
                        found = [(s["start"], s["stop"]) for s in spans[i].as_py() or ()]
                    kept, merged = cut(t, found)
                    yield k1[i].as_py(), k2[i].as_py(), len(t), [{"start": a, "stop": z} for a, z in merged], hashlib.sha256(kept).hexdigest() if digest else kept

        yield from _batches(rows(), schema, 2_000)

    out = c.written(joined.mapInArrow(run, f"k1 long, k2 long, n_bytes long, spans array<struct<start:int,stop:int>>, kept {'string' if digest else 'binary'}"), "substring-results")
    c.drop_written(spans)
    drop_texts(texts)
    return out


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir).select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    found = dedup(docs, digest=True).select(*_KEY, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))
    own = docs.select("doc_id", *content_key(F.coalesce("text", F.lit(""))))
    return own.join(found, _KEY).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
