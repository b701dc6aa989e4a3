"""Operator 6, language identification by cross-parsing entropy.

From a bounded sample of its labelled texts, each language gets a suffix automaton, made total: where
it has no transition, it goes on from its beginning and a phrase begins. Running a text through it
counts the phrases of the greedy longest-match parse. Phrases times the logarithm of the sample's
length, over the length of the text, estimates the cross entropy; the least wins. Transitions are packed
into one sparse table, whose size follows the samples, not states times letters.

Texts are parsed whole, as lower-case letters with one separator for each run of anything else.
Blocks of BLOCK symbols are parsed side by side, as if each began a text; then each is parsed again from the state in which
the block before it ended, until both parses are in one state. So the phrases are those of the whole text.

Edge cases. `und` with score 0: a null text, one without letters, or nothing to learn from. Ties go
to the first language by code point. Null or other languages than those learned are never
predicted; rows without id are learned from never and aren't held out. Repeated rows are judged
each; of repeated texts one is learned from. Other columns of the input are kept.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import common as c

#: The sample to fit: texts of each language, characters of each text.
MAX_TEXTS, MAX_CHARS = 64, 250
BLOCK = 1024
#: Symbols times languages that are parsed at once.
_BATCH = 1 << 22
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    #: Symbol of each code point: 0 is no letter, 1 a letter that the sample doesn't have.
    symbols: np.ndarray
    #: A state's transition by a symbol is at base[state] + symbol, if that place's owner is the state. States of all languages are numbered on.
    base: np.ndarray
    owner: np.ndarray
    next: np.ndarray
    #: By language and symbol: where a phrase that begins with the symbol goes.
    begin: np.ndarray
    starts: np.ndarray
    log_size: np.ndarray

    def step(self, state: np.ndarray, lang: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the next states, whether a phrase began)."""
        at = self.base[state] + symbol
        goes_on = self.owner[at] == state
        return np.where(goes_on, self.next[at], self.begin[lang, symbol]), ~goes_on


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the beginning."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for s in symbols:
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and s not in nexts[p]:
            nexts[p][s] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][s]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nexts[p].get(s) == q:
                    nexts[p][s] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


def packed(nexts: list[dict[int, int]], n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, next) of an automaton's states but the first: rows are laid over each other where they don't touch."""
    base, owner, to = np.zeros(len(nexts), np.int64), [], []
    free = 0
    for q in sorted(range(1, len(nexts)), key=lambda q: -len(nexts[q])):
        row = sorted(nexts[q])
        if not row:
            continue
        # Long rows look near the end only; short ones fill what they leave.
        p = free if len(row) == 1 else max(free, len(owner) - 4 * n_symbols)
        while any(x < len(owner) and owner[x] >= 0 for x in (p + s - row[0] for s in row)):
            p += 1
        more = p + row[-1] - row[0] + 1 - len(owner)
        owner += [-1] * more
        to += [0] * more
        for s in row:
            owner[p + s - row[0]], to[p + s - row[0]] = q, nexts[q][s]
        base[q] = p - row[0] + n_symbols
        while free < len(owner) and owner[free] >= 0:
            free += 1
    around = np.full(n_symbols, -1)
    return base, np.concatenate([around, np.array(owner, np.int64), around]), np.concatenate([around, np.array(to, np.int64), around])


def fit(samples: dict[str, list[str]]) -> Model:
    """A model of bounded samples of text by language."""
    samples = {k: [t for t in v if any(map(str.isalpha, t))] for k, v in sorted(samples.items())}
    samples = {k: v for k, v in samples.items() if v}
    letters = sorted({ch.lower()[0] for v in samples.values() for t in v for ch in t if ch.isalpha()})
    known = {ch: i + 2 for i, ch in enumerate(letters)}
    symbols = np.zeros(0x110000, np.uint16)
    for cp in range(0x110000):
        if unicodedata.category(ch := chr(cp))[0] == "L":
            symbols[cp] = known.get(ch.lower()[0], 1)
    n = len(letters) + 2
    parts, begins, starts, sizes, states, places = [], [], [], [], 0, 0
    for texts in samples.values():
        seq = np.concatenate([_symbols_of(symbols, [t])[0] for t in texts])
        nexts = automaton(seq.tolist())
        begin = np.full(n, states, np.int64)  # a symbol that the sample lacks is a phrase of its own
        for s, to in nexts[0].items():
            begin[s] += to
        base, owner, to = packed(nexts, n)
        parts.append((base + places, np.where(owner < 0, owner, owner + states), to + states))
        begins.append(begin)
        starts.append(states)
        sizes.append(math.log(len(seq) + 1))
        states, places = states + len(nexts), places + len(owner)
    joined = [np.concatenate(x).astype(np.int32) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int32)] * 3
    return Model(list(samples), symbols, *joined, np.array(begins, np.int32).reshape(-1, n), np.array(starts, np.int32), np.array(sizes))


def _symbols_of(symbols: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts one after the other, how many each has, and its letters; runs of no letters become one."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbols[cps]
    row = np.repeat(np.arange(len(texts)), lengths)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (row[1:] != row[:-1])
    s, row = s[keep], row[keep]
    return s, np.bincount(row, minlength=len(texts)), np.bincount(row, weights=s > 0, minlength=len(texts))


def phrases(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrases by text and language, symbols by text, letters by text)."""
    s, n, letters = _symbols_of(model.symbols, texts)
    s = s.astype(np.int32)
    blocks = -(-n // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    first = np.cumsum(n) - n
    within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[owner] + within * BLOCK
    size = np.minimum(n[owner] - within * BLOCK, BLOCK)
    order = np.argsort(-size, kind="stable")
    at = begin[order]
    active = np.searchsorted(-size[order], -np.arange(BLOCK), side="left")  # blocks longer than each step
    langs = np.arange(len(model.languages))[:, None]
    count = np.zeros((len(langs), len(owner)), np.int64)
    state = np.repeat(model.starts[:, None], len(owner), axis=1)
    for t in range(int(size.max()) if len(size) else 0):
        k = active[t]
        state[:, :k], began = model.step(state[:, :k], langs, s[at[:k] + t])
        count[:, :k] += began
    back = np.argsort(order)
    count, state = count[:, back], state[:, back]
    _join(model, s, begin, size, within, count, state)
    out = np.zeros((len(texts), len(langs)), np.int64)
    np.add.at(out, owner, count.T)
    return out, n, letters


def _join(model: Model, s: np.ndarray, begin: np.ndarray, size: np.ndarray, within: np.ndarray, count: np.ndarray, state: np.ndarray) -> None:
    """Makes counts by language and block, of blocks that each begin at the beginning and end in `state`, those of whole texts."""
    lang, block = (x.ravel() for x in np.meshgrid(np.arange(len(count)), np.flatnonzero(within > 0), indexing="ij"))
    own, true = model.starts[lang], state[lang, block - 1]
    left = true != own
    t, late = 0, []
    while left.any():
        lang, block, own, true = lang[left], block[left], own[left], true[left]
        over = t >= size[block]
        late += zip(lang[over].tolist(), block[over].tolist(), true[over].tolist(), strict=True)
        lang, block, own, true = lang[~over], block[~over], own[~over], true[~over]
        symbol = s[begin[block] + t]
        own, a = model.step(own, lang, symbol)
        true, b = model.step(true, lang, symbol)
        count[lang, block] += b.astype(np.int64) - a
        left = own != true
        t += 1
    # Blocks without a common state, as in periodic text: the next ones are parsed one by one, while they don't begin as was assumed.
    walked = set()
    for i, j, end in sorted(late):
        if (i, j) in walked:
            continue
        while state[i, j] != end and j + 1 < len(size) and within[j + 1] > 0:
            j += 1
            count[i, j], end = _walk(model, i, end, s[begin[j] : begin[j] + size[j]].tolist())
            walked.add((i, j))


def _walk(model: Model, lang: int, state: int, symbols: list[int]) -> tuple[int, int]:
    """(phrases begun, last state) from a state on."""
    n, begin, base, owner, to = 0, model.begin[lang], model.base, model.owner, model.next
    for x in symbols:
        at = base[state] + x
        if owner[at] == state:
            state = to[at]
        else:
            state, n = begin[x], n + 1
    return n, int(state)


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. The score is the winner's share when each language weighs exp(-its phrases' excess)."""
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    count, n, letters = phrases(model, texts)
    h = count * model.log_size / np.maximum(n, 1)[:, None]
    best = np.argmin(h, axis=1)
    excess = (h - h.min(axis=1, keepdims=True)) * np.maximum(n, 1)[:, None] / model.log_size.mean()
    score = np.where(letters > 0, 1 / np.exp(-np.minimum(excess, 700)).sum(axis=1), 0.0)
    return [model.languages[b] if x > 0 else UNKNOWN for b, x in zip(best.tolist(), letters.tolist(), strict=True)], score


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on the rows where `train` holds, whatever the number of languages. No more than each one's sample comes to the driver."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("lang", "text"))
    firsts = [r[0] for r in rows.groupBy("lang", F.pmod("h", F.lit(MAX_TEXTS)).alias("b")).agg(F.min("h").alias("h")).select("h").collect()]
    start = F.greatest(F.lit(1), (F.length("text") - MAX_CHARS) / 2).cast("int")
    sample = rows.where(F.col("h").isin(firsts)).select("lang", "h", F.substring(F.col("text"), start, F.lit(MAX_CHARS)).alias("text")).distinct().orderBy("lang", "h").collect() if firsts else []
    texts: dict[str, list[str]] = {}
    for r in sample:
        texts.setdefault(r["lang"], []).append(r["text"])
    return fit(texts)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with __attesta_lang and __attesta_score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        model, langs, scores, batch, size = shared.value, [], [], [], 0
        for t in texts:
            batch.append(t)
            size += len(t)
            if size * max(1, len(model.languages)) >= _BATCH:
                x, y = predict(model, batch)
                langs += x
                scores.append(y)
                batch, size = [], 0
        x, y = predict(model, batch)
        return pd.DataFrame({"lang": langs + x, "score": np.concatenate([*scores, y])})

    out = docs.withColumn(f"{c.OWN}judged", judged(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumns({f"{c.OWN}lang": F.col(f"{c.OWN}judged.lang"), f"{c.OWN}score": F.col(f"{c.OWN}judged.score")}).drop(f"{c.OWN}judged")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = learn(docs, F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col(f"{c.OWN}lang").alias("lang_pred"), F.col(f"{c.OWN}score").alias("score"))
