"""Operator 5, BPE encoding and decoding by a table of distinct words.

A word is a maximal run without ASCII white space. The tokenizer drops white space and never merges
across it, so that a text's ids are those of its words one after the other. Spark splits all texts into
words and counts them; each word of the table is encoded once, and its ids are joined back by position.

The table that goes to every executor is bounded: TABLE_WORDS words of at most WORD_BYTES bytes,
the most frequent by the number of texts over all documents. Words beyond it (invented or misspelt, mostly seen once)
are encoded once for each batch of texts they occur in, by the same tokenizer, with the same ids: shuffling every occurrence of
them, and the texts, to a join by word would cost several times the input in disk.

Decoding joins the ids of the table's words, by position, to the vocabulary's table of ids and pieces and puts a space
between pieces, as the library does for a tokenizer without a decoder. So each of these words is decoded once, by a join, and a text is its decoded words. The
words beyond the table take their pieces from the same vocabulary in place, as does `decode`, whose ids may be any.

Edge cases. A null text counts as empty: no ids, an empty text. Null ids decode to null. Unknown ids decode to nothing, as in the library.
Repeated rows are encoded each; other columns are kept, but for those that have the name of a new one: they are replaced.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from attesta.llm import common as c

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

TABLE_WORDS, WORD_BYTES = 200_000, 64
#: Words outside the table that a task keeps, with their ids.
_KEPT = 50_000
#: Words that are encoded at once.
_WORDS = 1_000
#: Rows that are encoded or decoded at once.
_ROWS = 256


@functools.lru_cache(maxsize=1)
def tokenizer(definition: str) -> Tokenizer:
    """One for each process: a worker runs many tasks, and each tokenizer leaves its memory in pieces."""
    t = Tokenizer.from_str(definition)
    t.no_padding()
    t.no_truncation()
    return t


def encoded(t: Tokenizer, words: list[bytes]) -> list[bytes]:
    """Ids of each word, as little-endian 32-bit numbers."""
    out = []
    for at in range(0, len(words), _WORDS):
        found = t.encode_batch_fast([w.decode("utf-8") for w in words[at : at + _WORDS]], add_special_tokens=False)
        out += [array("i", x.ids).tobytes() for x in found]
    return out


def listed(rows: list[bytes]) -> pa.ListArray:
    """Rows of little-endian 32-bit numbers as an array of lists."""
    ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in rows])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32()))


def frequent_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word): the most frequent words, as many of the least count as fit the table."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.col(text_col), c.SPACE, -1))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.octet_length("word") <= WORD_BYTES) & (F.col("word") != ""))
    counts = c.written(counts.withColumn("n", F.least("n", F.lit(1 << 16)).cast("int")), "bpe-words")
    total, least = 0, 1 << 16
    for n, words_of in counts.groupBy("n").agg(F.count("*").alias("w")).orderBy(F.desc("n")).collect():
        total += words_of
        if total > TABLE_WORDS:
            break
        least = n
    return counts.where(F.col("n") >= least).select("word")


def vocabulary(spark: SparkSession, definition: str) -> DataFrame:
    """(id, piece): the tokenizer's pieces, special tokens included; as many rows as the file has."""
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(pieces(definition))), pa.int32()), "piece": pa.array(pieces(definition), pa.string())})).where("piece IS NOT NULL")


def decoded_words(words: DataFrame, definition: str) -> DataFrame:
    """`words` (word, ids: array<int>) with text, its ids decoded by a join to the vocabulary; a word without ids has the empty text."""
    parts = words.select("word", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(vocabulary(words.sparkSession, definition)), "id")
    texts = parts.groupBy("word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ").alias("text"))
    return words.join(texts, "word", "left").withColumn("text", F.coalesce("text", F.lit("")))


def word_table(docs: DataFrame, definition: str, text_col: str = "text") -> dict[bytes, tuple[bytes, bytes]]:
    """Ids and decoded text of the frequent words of all documents, each encoded and decoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(definition)
        for b in batches:
            words = b.column(0).to_pylist()
            ids = [np.frombuffer(x, "<i4") for x in encoded(t, [w.encode() for w in words])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    words = c.written(frequent_words(docs, text_col).mapInArrow(encode, "word string, ids array<int>"), "bpe-table")
    rows = decoded_words(words, definition).select("word", "ids", "text").toArrow().combine_chunks()
    c.drop_written(words)
    ids = rows["ids"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    return {w.encode(): (np.asarray(i.values, "<i4").tobytes(), x.encode()) for w, i, x in zip(rows["word"].to_pylist(), ids, rows["text"].to_pylist(), strict=True)}


def _added(df: DataFrame, column: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], fields: list[T.StructField]) -> DataFrame:
    """`df` with the columns that the function that `make` returns on an executor makes of `column`, a few rows at a time."""
    names = df.columns
    new = [f.name for f in fields]
    kept = [i for i, n in enumerate(names) if n not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                b = batch.slice(at, _ROWS)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *function(b.column(names.index(column)))], [*(names[i] for i in kept), *new])

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in kept), *fields]))


def encode(docs: DataFrame, definition: str, table: dict[bytes, tuple[bytes, bytes]], text_col: str = "text", name: str = "ids", decoded: str | None = None) -> DataFrame:
    """`docs` with the column `name`: array<int>; and, if `decoded` is given, with a column of that name: the words' decoded texts."""
    # Columns, not objects: each worker of an executor has a copy.
    packed = [pa.array([w.decode("utf-8") for w in table], pa.large_string()), listed([x[0] for x in table.values()]), pa.array([x[1].decode("utf-8") for x in table.values()], pa.large_string())]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("word", pa.large_string()), ("ids", pa.list_(pa.int32())), ("text", pa.large_string())])) as out:
        out.write_batch(pa.RecordBatch.from_arrays(packed, ["word", "ids", "text"]))
    shared = docs.sparkSession.sparkContext.broadcast((definition, sink.getvalue().to_pybytes()))

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        definition, data = shared.value
        t, known = tokenizer(definition), pa.array(pieces(definition), pa.string())
        base = pa.ipc.open_stream(pa.py_buffer(data)).read_next_batch()
        place = {w.encode("utf-8"): i for i, w in enumerate(base.column(0).to_pylist())}
        first = len(place)
        ids, texts = base.column(1), base.column(2)
        extra: list[bytes] = []

        def learn(new: list[bytes]) -> None:
            nonlocal ids, texts
            if not new:
                return
            place.update(zip(new, range(first + len(extra), first + len(extra) + len(new)), strict=True))
            extra.extend(new)
            found = listed(encoded(t, new))
            ids, texts = pa.concat_arrays([ids, found]), pa.concat_arrays([texts, joined(found, known).cast(pa.large_string())])

        def forget() -> None:
            nonlocal ids, texts
            for w in extra:
                del place[w]
            extra.clear()
            ids, texts = base.column(1), base.column(2)

        def both(column: pa.Array) -> list[pa.Array]:
            rows = [(x.as_py() or "").encode("utf-8").split() for x in column]
            words = set(itertools.chain.from_iterable(rows))
            if len(extra) > _KEPT:
                forget()
            learn(list(words.difference(place)))
            ends = np.concatenate(([0], np.cumsum([len(row) for row in rows])))
            at = np.fromiter(map(place.__getitem__, itertools.chain.from_iterable(rows)), np.int64, int(ends[-1]))
            taken = ids.take(pa.array(at))
            out = pa.ListArray.from_arrays(pa.array(_offsets(taken).to_numpy()[ends], pa.int32()), taken.flatten())
            if decoded is None:
                return [out]
            # A word without ids has no text, and no space beside it.
            some = np.asarray(pc.binary_length(texts))[at] > 0
            spaced = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some)))[ends], pa.int64()), texts.take(pa.array(at[some])))
            return [out, pc.binary_join(spaced, pa.scalar(" ", pa.large_string())).cast(pa.string())]

        return both

    fields = [T.StructField(name, T.ArrayType(T.IntegerType()))]
    return _added(docs, text_col, make, fields if decoded is None else [*fields, T.StructField(decoded, T.StringType())])


@functools.lru_cache(maxsize=1)
def pieces(definition: str) -> list[str | None]:
    """The vocabulary's pieces by id; ids that it lacks are null."""
    data = json.loads(definition)
    ids = dict(data["model"]["vocab"]) | {x["content"]: x["id"] for x in data["added_tokens"]}
    out: list[str | None] = [None] * (max(ids.values(), default=-1) + 1)
    for piece, i in ids.items():
        out[i] = piece
    return out


def joined(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """The pieces of each row's ids, with spaces between them."""
    values = ids.flatten()
    within = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(table)))
    found = table.take(pc.if_else(within, values, None))
    out = pc.binary_join(pa.ListArray.from_arrays(_offsets(ids), found), " ")
    if found.null_count:
        lists = pa.ListArray.from_arrays(_offsets(ids), found).to_pylist()
        out = pa.array([" ".join(x for x in row if x is not None) for row in lists], pa.string())
    return pc.if_else(ids.is_valid(), out, pa.scalar(None, pa.string()))


def decode(rows: DataFrame, definition: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """`rows` with the column `name`: the text of the ids, special tokens included."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces(definition))

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        table = pa.array(shared.value, pa.string())
        return lambda ids: [joined(ids, table)]

    return _added(rows, ids_col, make, [T.StructField(name, T.StringType())])


def _offsets(ids: pa.ListArray) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    return pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())


def definition_of(path: str) -> str:
    """A tokenizer file's text, read on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    definition = definition_of(public_tokenizers.path("word_bpe_49k.json"))
    docs = c.documents(spark, sf_dir).select("doc_id", "text")
    out = encode(docs, definition, word_table(docs, definition), decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
