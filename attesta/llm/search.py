"""Operator 8, exact top-k search by BM25 over sharded inverted indexes with block-max pruning.

Index. Each task cuts its documents into shards and writes one row for each: its vocabulary (64-bit
hashes of terms) and the inverted list of each term, documents in order with their frequencies. Documents are ordered by their most common
frequent term, so that documents of one language lie together. A term is a maximal run of
letters and digits, in lower case. Sums over the shards give global statistics: documents, mean length and
document frequencies. A query's terms count once each: score = sum of idf * tf (k1 + 1) / (tf + k1 (1 - b + b length / mean)).

Search. Query blocks of bounded size go to all shards. Every list is cut at the same blocks of BLOCK documents and holds its largest weight in
each. As in block-max WAND, the sum of a query's block maxima bounds what a block's documents can score: the next pivot is the first block,
in order of documents, whose bound reaches the threshold; the postings of all blocks before it are skipped, its own are scored,
and the threshold rises to the k-th best score so far. The blocks of the highest bounds are scored first, so that the threshold is
high from the start. Pivots are sought a strip of blocks at a time, with arrays. Terms that an eighth of a shard has are dense lists, scored for a batch of queries at once in the blocks where any of them has a pivot.
Whole texts as queries have hundreds of terms: bounds are loose, nearly every block has a pivot, and seeking them costs several times what the scores do. Queries of more than LONG
terms therefore read their lists whole, in single precision, and only documents that may reach the threshold are scored exactly. A task keeps a query's threshold from shard to shard.
A first wave over some of the shards gives each query a score that k documents reach; the second wave over
the others begins there and returns only what reaches it. The best k of both are the exact global top k.

Edge cases. A null or empty text has no terms: it matches nothing and, as a query, returns no rows. Ties in score go
to the lower id, null last. Repeated rows are found each. A query may repeat: rows with an equal id are searched as one query each under that id and
their results merge. With fewer than k matches, all are returned. Other columns don't matter.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm import common as c

K1, B = 1.2, 0.75
BLOCK = 8
#: Postings of a row; terms of a query, at most, for which pivots are sought.
WIDE, LONG = 8, 8
#: A heavy term is in more than this part of a shard's documents.
HEAVY = 8
#: Documents and characters of a shard, at most; a longer text is a shard by itself.
SHARD_DOCS, SHARD_CHARS = 4_096, 1 << 24
#: Terms of the queries that are broadcast at once, of 16 bytes each, on average.
QUERY_TERMS = 1 << 20
#: Parts of a shard's blocks between which the threshold rises; blocks scored before all others.
STRIPS, PRIMED = 2, 4
#: Decimals of a score. Shards sum in different orders; what is equal to these digits ties.
DIGITS, TIE = 6, 1e-6
_TERM = regex.compile(r"[\p{L}\p{N}]+")
_BATCH = 256


def term_hashes(terms: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in terms], np.uint64)


def _texts_to_shard(ids: list, texts: list[str]) -> dict:
    """Columns of a shard's row. Only a document's different terms are kept while others are read."""
    local: dict[str, int] = {}
    tids, tfs, lengths = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = Counter(_TERM.findall(text.lower()))
        tids.append(np.fromiter((local.setdefault(t, len(local)) for t in found), np.int32, len(found)))
        tfs.append(np.fromiter(found.values(), np.int32, len(found)))
        lengths[i] = tfs[-1].sum()
    sizes = np.fromiter(map(len, tids), np.int64, len(tids))
    df = np.bincount(np.concatenate(tids), minlength=len(local)) if tids else np.zeros(0, np.int64)
    # Documents are ordered by their most frequent term: mostly a function word of their language.
    top = np.fromiter((x[np.argmax(y)] if len(x) else -1 for x, y in zip(tids, tfs, strict=True)), np.int64, len(tids))
    order = np.lexsort((lengths, top))
    hashes = term_hashes(list(local))
    by_hash = np.argsort(hashes)
    place = np.empty(len(local), np.int32)
    place[by_hash] = np.arange(len(local))
    terms = np.concatenate([place[tids[i]] for i in order]) if tids else np.zeros(0, np.int32)
    counts = np.concatenate([tfs[i] for i in order]) if tids else np.zeros(0, np.int32)
    by_term = np.argsort(terms, kind="stable")  # then by document
    return {
        "n": len(texts), "length": int(lengths.sum()), "ids": [ids[i] for i in order],
        "lengths": lengths[order].astype("<i4").tobytes(), "vocabulary": hashes[by_hash].astype("<u8").tobytes(), "df": df[by_hash].astype("<i4").tobytes(),
        "docs": np.repeat(np.arange(len(texts)), sizes[order])[by_term].astype("<i4").tobytes(), "tf": counts[by_term].astype("<i4").tobytes(),
    }


_ROW = "n int, length long, ids array<long>, lengths binary, vocabulary binary, df binary, docs binary, tf binary"
_SCHEMA = pa.schema([("n", pa.int32()), ("length", pa.int64()), ("ids", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("lengths", "vocabulary", "df", "docs", "tf"))])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each shard, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_texts_to_shard(ids, texts)], schema=_SCHEMA)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if texts and (len(texts) >= SHARD_DOCS or size + len(t) > SHARD_CHARS):
                    yield row()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return c.written(rows.mapInArrow(run, _ROW), "search-index")


def document_frequencies(index: DataFrame) -> DataFrame:
    """(h, df) over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v, "<i8")), pa.array(np.frombuffer(n, "<i4").astype(np.int64))], ["h", "df"])

    return index.select("vocabulary", "df").mapInArrow(run, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))


def weighted_queries(queries: DataFrame, frequencies: DataFrame, n_docs: int) -> DataFrame:
    """(q, id, hs, idf) of queries (id, text) that have a term of the index: hashes, and weights in their order."""

    @F.arrow_udf("array<long>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([term_hashes(sorted(set(_TERM.findall(t.lower())))).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    rows = queries.select("id", F.monotonically_increasing_id().alias("q"), hashed(F.coalesce("text", F.lit(""))).alias("hs"))
    rows = c.written(rows, "search-queries")
    terms = rows.select("q", "id", F.explode("hs").alias("h")).join(frequencies, "h")
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    lists = terms.groupBy("q", "id").agg(F.sort_array(F.collect_list(F.struct("h", idf.alias("idf")))).alias("terms"))
    return lists.select("q", "id", F.transform("terms", lambda x: x["h"]).alias("hs"), F.transform("terms", lambda x: x["idf"]).alias("idf"))


class Shard:
    """A shard's lists in memory, with weights for the global mean length.

    Light terms have rows of WIDE postings, the last one filled up with weights of 0, so that a list is copied in runs. Heavy terms, that a
    HEAVY-th of the documents have, have a row of weights by document. Pivots need more: for light terms entries, one for each block that has them,
    the largest weight and where their postings begin; for heavy terms a row by block.
    """

    def __init__(self, row: dict, mean_length: float) -> None:
        self.ids, self.n = row["ids"], row["n"]
        lengths, self.vocabulary, df, self.doc, tf = (np.frombuffer(row[k], t) for k, t in (("lengths", "<i4"), ("vocabulary", "<u8"), ("df", "<i4"), ("docs", "<i4"), ("tf", "<i4")))
        self.df = df.astype(np.int64)
        self.n_blocks = -(-self.n // BLOCK)
        self.weight = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * lengths / mean_length))[self.doc])
        postings = np.concatenate(([0], np.cumsum(self.df)))
        heavy = self.df * HEAVY > self.n
        self.heavy = np.where(heavy, np.cumsum(heavy) - 1, -1)
        of_heavy = np.repeat(heavy, self.df)
        self.at_heavy = np.repeat(self.heavy, self.df)[of_heavy] * (self.n_blocks * BLOCK) + self.doc[of_heavy], np.flatnonzero(of_heavy)
        self.n_heavy, self.idf = int(heavy.sum()), np.zeros(len(self.df))
        self.rows = np.where(heavy, 0, -(-self.df // WIDE))
        self.row_of = np.cumsum(self.rows) - self.rows
        light = np.flatnonzero(~of_heavy)
        self.at_light = (np.repeat(self.row_of * WIDE - postings[:-1], self.df) + np.arange(len(self.doc)))[light], light

    def heavy_rows(self, kind: type) -> np.ndarray:
        out = np.zeros((self.n_heavy, self.n_blocks * BLOCK), kind)
        out.reshape(-1)[self.at_heavy[0]] = self.weight[self.at_heavy[1]]
        return out

    @functools.cached_property
    def by_doc(self) -> np.ndarray:
        return self.heavy_rows(np.float64)

    @functools.cached_property
    def by_block(self) -> np.ndarray:
        return self.by_doc.reshape(self.n_heavy, self.n_blocks, BLOCK).max(axis=2) if self.n_heavy else np.zeros((0, self.n_blocks))

    @functools.cached_property
    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the entries: where their postings begin, their block, their largest weight; and the first entry of each term."""
        key = np.repeat(np.arange(len(self.df)), self.df) * self.n_blocks + self.doc // BLOCK
        first = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
        block_term, block = np.divmod(key[first[:-1]], max(self.n_blocks, 1))
        most = np.maximum.reduceat(self.weight, first[:-1]) if len(key) else np.zeros(0)
        return first, block, most, np.searchsorted(block_term, np.arange(len(self.df) + 1))

    @functools.cached_property
    def by_text(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The postings in order of documents: terms and weights, and where each document begins."""
        order = np.argsort(self.doc.astype(np.uint16) if self.n <= 1 << 16 else self.doc, kind="stable")
        terms = np.repeat(np.arange(len(self.df), dtype=np.int32), self.df)
        return terms[order], self.weight[order], np.concatenate(([0], np.cumsum(np.bincount(self.doc, minlength=self.n))))

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms in the vocabulary, -1 for those that the shard lacks."""
        if not len(self.vocabulary):
            return np.full(len(terms), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == terms, at, -1)

    def local(self, hs: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the vocabulary of those of a query's terms that the shard has, and their weights."""
        at = self.places(hs)
        return at[at >= 0], idf[at >= 0]

    def exact(self, terms: np.ndarray, idf: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of some documents, from their own terms."""
        of_text, weights, starts = self.by_text
        self.idf[terms] = idf
        out = np.array([self.idf[of_text[starts[d] : starts[d + 1]]] @ weights[starts[d] : starts[d + 1]] for d in docs.tolist()])
        self.idf[terms] = 0
        return out


class Queries:
    """Queries (hashes of terms in order, their weights, floor) as arrays: each different term is looked up once a shard. A term has one weight.

    They are dealt to batches by their most common term, so that those of one language share their heavy terms. Searches raise the floors.
    """

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
        sizes = [len(hs) for hs, _, _ in queries]
        self.starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        flat = np.concatenate([np.zeros(0, np.uint64), *[hs for hs, _, _ in queries]])
        self.terms, at = np.unique(flat, return_inverse=True)
        self.at = at.astype(np.int32)
        self.idf = np.zeros(len(self.terms))
        self.idf[self.at] = np.concatenate([np.zeros(0), *[x for _, x, _ in queries]])
        self.floors = np.array([floor for *_, floor in queries], np.float64)
        self.best: dict[int, np.ndarray] = {}
        rarest = np.argsort(self.idf, kind="stable")
        rank = np.empty(len(rarest), np.int64)
        rank[rarest] = np.arange(len(rarest))
        common = [rank[self.at[a:b]].min() if b > a else -1 for a, b in itertools.pairwise(self.starts)]
        self.order = np.lexsort((sizes, common)) if queries else np.zeros(0, np.int64)

    def local(self, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the terms that a shard has, by their places, and their weights."""
        at = places[self.at]
        kept = np.flatnonzero(at >= 0)
        stops = np.searchsorted(kept, self.starts)
        at, idf = at[kept], self.idf[self.at[kept]]
        return [(at[a:b], idf[a:b]) for a, b in itertools.pairwise(stops.tolist())]

    def found(self, q: int, scores: np.ndarray, k: int) -> None:
        """Raises a query's floor to the k-th best of all documents found so far, each of which is given once."""
        best = np.concatenate((self.best.get(q, scores[:0]), scores))
        if len(best) >= k:
            best = np.partition(best, -k)[-k:]
            self.floors[q] = max(self.floors[q], best[0] - TIE)
        self.best[q] = best


class Lists:
    """A shard's whole lists in single precision, each with its term's weight: for finding the documents that may reach a floor."""

    def __init__(self, shard: Shard, places: np.ndarray, idf: np.ndarray) -> None:
        self.shard, n = shard, shard.n_blocks * BLOCK
        of_term = np.zeros(len(shard.df), np.float32)
        of_term[places[places >= 0]] = idf[places >= 0]
        self.by_doc = np.ascontiguousarray(shard.heavy_rows(np.float32).T) * of_term[shard.heavy >= 0]
        place, light = shard.at_light
        self.docs, self.weights = np.zeros((int(shard.rows.sum()), WIDE), np.int32), np.zeros((int(shard.rows.sum()), WIDE), np.float32)
        self.docs.reshape(-1)[place] = shard.doc[light]
        self.weights.reshape(-1)[place] = shard.weight[light]
        self.weights *= np.repeat(of_term, shard.rows)[:, None]
        self.n, self.light = n, np.where(shard.heavy < 0, shard.df, 0)
        # Heavy terms are summed in single precision, in any order; each adds its rounding.
        self.slack = (shard.n_heavy + 16) * 2.0**-23

    def scores(self, part: list[np.ndarray]) -> np.ndarray:
        """By query and document; off by less than `slack` of the score."""
        heavy = [h[h >= 0] for h in (self.shard.heavy[terms] for terms in part)]
        wanted = np.zeros((len(part), self.shard.n_heavy), np.float32)
        for i, h in enumerate(heavy):
            wanted[i, h] = 1
        used = np.flatnonzero(wanted.any(axis=0))
        few = 2 * len(used) < self.shard.n_heavy
        out = np.ascontiguousarray(((self.by_doc[:, used] if few else self.by_doc) @ (wanted[:, used] if few else wanted).T).T)
        for i, terms in enumerate(part):
            sizes = self.shard.rows[terms]
            stops = np.cumsum(sizes)
            rows = np.repeat(self.shard.row_of[terms] - stops + sizes, sizes)
            rows += np.arange(len(rows))
            if len(rows):
                out[i] += np.bincount(self.docs.take(rows, axis=0).reshape(-1), weights=self.weights.take(rows, axis=0).reshape(-1), minlength=self.n)
        return out


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    sizes = stops - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))


class Pivots:
    """One query over a shard's light lists."""

    def __init__(self, shard: Shard, terms: np.ndarray, idf: np.ndarray) -> None:
        self.shard = shard
        self.first, block, self.most, blocks_of = shard.entries
        a, b = blocks_of[terms], blocks_of[terms + 1]
        self.entries, self.idf = _ranges(a, b).astype(np.int32), np.repeat(idf, b - a)
        self.block = block[self.entries].astype(np.int32)

    def bounds(self) -> np.ndarray:
        return np.bincount(self.block, weights=self.most[self.entries] * self.idf, minlength=self.shard.n_blocks)

    def score(self, wanted: np.ndarray) -> tuple[np.ndarray, int]:
        """Scores by document from the postings of the wanted blocks alone, and how many postings those are."""
        keep = wanted[self.block]
        entries = self.entries[keep]
        a, b = self.first[entries], self.first[entries + 1]
        at = _ranges(a, b)
        return np.bincount(self.shard.doc[at], weights=self.shard.weight[at] * np.repeat(self.idf[keep], b - a), minlength=self.shard.n_blocks * BLOCK), len(at)


def _documents(blocks: np.ndarray) -> np.ndarray:
    return (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()


def search_shard(shard: Shard, queries: Queries | list, k: int, touched: Counter | None = None) -> Iterator[tuple[int, list[int], list[float]]]:
    """(query, places of documents, scores): the best k of the shard that reach the query's floor, and all that tie with the k-th.

    Queries of more than LONG terms in the shard read their lists whole: with hundreds of terms nearly all blocks have a pivot, and bounds cost more than
    scores. What may reach the floor is scored again in double precision. Others are searched by pivots. Where k documents were found, the floor rises to the k-th.
    `touched` counts the postings of the queries' light terms (light), those that were scored (light_scored), and for heavy terms the blocks of the batch (blocks, blocks_scored).
    """
    touched = Counter() if touched is None else touched
    asked = queries if isinstance(queries, Queries) else Queries(queries)
    places = shard.places(asked.terms)
    local = asked.local(places)
    long = [q for q in asked.order.tolist() if len(local[q][0]) > LONG]
    lists = Lists(shard, places, asked.idf) if long else None
    for start in range(0, len(long), _BATCH):
        part = long[start : start + _BATCH]
        scores = lists.scores([local[q][0] for q in part])
        n = int(sum(lists.light[local[q][0]].sum() for q in part))
        touched += Counter(light=n, light_scored=n, blocks=shard.n_blocks, blocks_scored=shard.n_blocks)
        for q, near in zip(part, scores, strict=True):
            place = np.flatnonzero((near > 0) & (near >= asked.floors[q] * (1 - lists.slack) - TIE))
            if len(place) > k:
                place = place[near[place] >= np.partition(near[place], -k)[-k] * (1 - 2 * lists.slack) - TIE]
            if not len(place):
                continue
            score = shard.exact(*local[q], place)
            asked.found(q, score, k)
            good = score >= asked.floors[q]
            if good.any():
                yield q, place[good].tolist(), score[good].tolist()
    yield from _by_pivots(shard, [(q, *x) for q, x in enumerate(local) if 0 < len(x[0]) <= LONG], asked, k, touched)


def _by_pivots(shard: Shard, queries: list[tuple[int, np.ndarray, np.ndarray]], asked: Queries, k: int, touched: Counter) -> Iterator[tuple[int, list[int], list[float]]]:
    for at in range(0, len(queries), _BATCH):
        part = queries[at : at + _BATCH]
        wanted = np.zeros((len(part), shard.n_heavy))
        pivots = []
        for i, (_, terms, idf) in enumerate(part):
            h = shard.heavy[terms]
            wanted[i, h[h >= 0]] = idf[h >= 0]
            pivots.append(Pivots(shard, terms[h < 0], idf[h < 0]))
        bounds = wanted @ shard.by_block + np.array([p.bounds() for p in pivots])
        # Sums in another order differ in the last digits: bounds get a little slack.
        bounds *= 1 + 1e-9
        thresholds = np.array([asked.floors[q] for q, _, _ in part])
        if k < shard.n:
            for i, p in enumerate(pivots):
                best = np.argsort(-bounds[i])[: max(PRIMED, -(-k // BLOCK))]
                best = best[bounds[i, best] >= max(thresholds[i], TIE)]
                mask = np.zeros(shard.n_blocks, bool)
                mask[best] = True
                docs = _documents(best)
                scores = p.score(mask)[0][docs] + wanted[i] @ shard.by_doc[:, docs]
                if len(scores) >= k:
                    thresholds[i] = max(thresholds[i], np.partition(scores, -k)[-k] - TIE)
        alive = (bounds >= thresholds[:, None]) & (bounds > 0)
        some = np.flatnonzero(alive.any(axis=0))
        docs = _documents(some)
        heavy = np.zeros((len(part), shard.n_blocks * BLOCK))
        heavy[:, docs] = wanted @ (shard.by_doc if len(some) == shard.n_blocks else shard.by_doc[:, docs])
        touched += Counter(blocks=shard.n_blocks, blocks_scored=len(some))
        step = -(-shard.n_blocks // STRIPS)
        for i, p in enumerate(pivots):
            places, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
            for start in range(0, shard.n_blocks, max(step, 1)):
                pivot = np.zeros(shard.n_blocks, bool)
                here = slice(start, start + step)
                pivot[here] = alive[i, here] & (bounds[i, here] >= thresholds[i])
                if not pivot.any():
                    continue
                light, n = p.score(pivot)
                touched["light_scored"] += n
                docs = _documents(np.flatnonzero(pivot))
                found = light[docs] + heavy[i, docs]
                places.append(docs[found > 0])
                scores.append(found[found > 0])
                all_ = np.concatenate(scores)
                if len(all_) > k:
                    thresholds[i] = max(thresholds[i], np.partition(all_, -k)[-k] - TIE)
            touched["light"] += int((p.first[p.entries + 1] - p.first[p.entries]).sum())
            place, score = np.concatenate(places), np.concatenate(scores)
            good = score >= thresholds[i]
            if good.any():
                asked.found(part[i][0], score[good], k)
                yield part[i][0], place[good].tolist(), score[good].tolist()


def _search(index: DataFrame, block: pa.Table, floors: dict[int, float], mean_length: float, k: int) -> DataFrame:
    """(q, found, score) of one block of queries over the shards of `index`."""
    block = block.combine_chunks()
    queries = []
    for i, q in enumerate(block["q"].to_pylist()):
        hs = block["hs"][i].values.to_numpy().view(np.uint64)
        order = np.argsort(hs)
        queries.append((q, hs[order], block["idf"][i].values.to_numpy()[order], floors.get(q, 0.0)))
    shared = index.sparkSession.sparkContext.broadcast(queries)
    schema = pa.schema([("q", pa.int64()), ("found", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        plain = [x[1:] for x in queries]
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.slice(i, 1).to_pylist()[0], mean_length)
                out: tuple[list, list, list] = ([], [], [])
                for at, places, scores in search_shard(shard, plain, k):
                    # Of many that tie with the k-th, the least ids are enough.
                    best = sorted(zip((-round(s, DIGITS) for s in scores), ((shard.ids[p] is None, shard.ids[p] or 0) for p in places), strict=True))[:k]
                    for s, (none, d) in best:
                        out[0].append(queries[at][0])
                        out[1].append(None if none else d)
                        out[2].append(-s)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return index.mapInArrow(run, "q long, found long, score double")


def _best(rows: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.col("found").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, found, score): the k best of `docs` for each of `queries` (id, text). Query rows that repeat id and text count once; texts under one id are searched together."""
    queries = queries.select("id", "text").distinct()
    index = build_index(docs, id_col, text_col)
    n_docs, length, n_shards = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    mean = length / n_docs if n_docs and length else 1.0
    frequencies = document_frequencies(index)
    asked = c.written(weighted_queries(queries, frequencies, n_docs), "search-asked")
    n_terms = asked.agg(F.coalesce(F.sum(F.size("hs")), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(n_terms / QUERY_TERMS))
    # Shards of the first wave: about the root of their number, by a hash of their vocabulary.
    first = F.pmod(F.xxhash64("vocabulary"), F.lit(max(1, round(math.sqrt(n_shards))))) == 0
    parts = []
    for i in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == i).select("q", "hs", "idf").toArrow()
        wave = c.written(_search(index.where(first), block, {}, mean, k), "search-wave")
        kth = _best(wave, "q", k).groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == k)
        floors = {r["q"]: r["s"] - TIE for r in kth.collect()}
        parts += [wave, c.written(_search(index.where(~first), block, floors, mean, k), "search-wave")]
    c.drop_written(index)
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    # Texts that share an id are one query: each row that any of them finds has its best score.
    copy = F.row_number().over(Window.partitionBy("q", "found").orderBy(F.desc("score")))
    found = found.join(asked.select("q", "id"), "q").withColumn("copy", copy).groupBy("id", "found", "copy").agg(F.max("score").alias("score"))
    return _best(found, "id", k).select("id", "rank", "found", "score")


def query_set(id_: Column) -> Column:
    """The stated query set: rows whose id is divisible by 100."""
    return id_ % 100 == 0


def op8_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir).select("doc_id", "text")
    asked = docs.where(query_set(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text")
    out = top_k(docs, asked)
    return out.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("found").alias("doc_id"), "score")
