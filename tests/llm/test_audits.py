"""Operators 11 to 13 against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import SCHEMA, corpus, saved, sentence

from attesta.llm import collocations, decontaminate, filter_audit, fm_index

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_with_passages():
    """The odd corpus, with copies under several ids, passages of a benchmark and symbols."""
    rng = random.Random(4)
    rows = corpus()
    items = [(str(i), sentence(rng, "en", rng.choice([3, 9, 10, 11, 40]))) for i in range(12)]
    items += [("7", sentence(rng, "de", 14)), ("z", items[4][1]), (None, "Solo-word"), ("none", "... !"), ("gone", None), ("é", "ünï çödé 12,5"), ("two", "alpha beta")]
    for i, (_, text) in enumerate(items):
        if text:
            around = sentence(rng, "fr", 20), sentence(rng, "fr", 120)
            rows.append((200 + i, f"{around[0]} {text.upper()}, {around[1]} # {text.replace(' ', '--')} alpha (BETA)", "fr", "a", 1))
            rows.append((300 + i, f"{around[0]} {text[: len(text) // 2]}", None, "a", 1))
    rows += [(400 + i, rows[40][1], "de", "b", 1) for i in range(5)] + [(500, "SHOUT " * 120, "", "b", 1), (None, rows[40][1], "de", "b", 1)]
    few = [sentence(rng, "en", 1) for _ in range(9)] + ["Ab", "ab ab", "x\ty"]
    rows += [(600 + i, f"{rng.choice('    ;')}{rng.choice(['  ', chr(9), ' '])}".join(rng.choice(few) for _ in range(90)), rng.choice(["en", None, "und"]), "b", 1) for i in range(60)]
    return rows, items


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("audits")
    rows, items = rows_with_passages()
    saved(spark, path, rows)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 420, 3)] + [(3, None, None), (3, 1, 1), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("own")).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").withColumn("lang", F.lit("own")).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    saved(spark, path, [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_collocations(spark, sf_dir, empty_dir):
    rows, _ = rows_with_passages()
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            n["und" if lang is None else lang] += len(words)
            for m in (1, 2, 3):
                for i in range(len(words) - m + 1):
                    f[lang if lang is not None else "und", tuple(words[i : i + m])] += 1
    found = {k: v for k, v in f.items() if v >= 10 and len(k[1]) > 1}
    longest = collections.Counter()
    for (lang, p), v in found.items():
        for q in {p[:2], p[1:]} if len(p) == 3 else ():
            longest[lang, q] = max(longest[lang, q], v)
    want = collections.defaultdict(list)
    for (lang, p), a in found.items():
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if not longest[lang, p] or 100 * longest[lang, p] < 50 * a:
            want[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    whole = {(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, x in want.items() for i, (score, a, p, left, right) in enumerate(sorted(x)[:2000])}
    got = collocations.op11_collocations(spark, sf_dir).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert len(got) == len(whole) > 20 and {tuple(r) for r in got} == whole
    assert collocations.op11_collocations(spark, empty_dir).count() == 0


def test_collocation_ranks_in_parts(spark):
    found = spark.createDataFrame([(lang, f"w{i % 90} x{i}", i % 7, 10 + i % 3) for lang in ("a", "b") for i in range(500)], "lang string, phrase string, score long, a long")
    got = collocations.ranked(found, 40).collect()
    for lang in ("a", "b"):
        want = sorted((-(i % 7), -(10 + i % 3), f"w{i % 90} x{i}") for i in range(500))[:40]
        assert [r["phrase"] for r in sorted((r for r in got if r["lang"] == lang), key=lambda r: r["rank"])] == [x[2] for x in want]


def test_collocation_scores_are_exact(spark):
    cases = [(10**15, 10**15, 10**15), (10**15 - 1, 10**15, 10**15 - 1), (3_037_000_500, 3_037_000_501, 9_999_999_999), (10, 10, 10), (10, 999_999_999_999, 10**15)]
    got = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", collocations.cut_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r["s"] == 10**6 * r["a"] ** 2 // (r["l"] * r["r"]) for r in got) and len(got) == len(cases)


def test_collocation_marks_lose_nothing(spark):
    """Phrases hash alike whether they are counted from pieces or read as strings."""
    parts = spark.createDataFrame([("en", "a b c d", 6), ("de", "a b c d", 9), ("en", "x a b c", 5)], "lang string, piece string, times long")
    got = {(r["lang"], r["phrase"]): r["f"] for r in collocations.counts(parts, 4, 10).collect()}
    assert got == {("en", x): 11 for x in ("a", "b", "c", "a b", "b c", "a b c")}


def test_filter_audit(spark, sf_dir, empty_dir):
    rows, _ = rows_with_passages()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 420, 3)] + [(3, 1, 1)]
    good, toxic = ({i for i, q, t in labels if (q, t)[x]} for x in (0, 1))
    ids = collections.defaultdict(list)
    for i, text, *_ in rows:
        if i is not None:
            ids[text or ""].append(i)
    docs = []
    for i, text, lang, *_ in rows:
        t = text or ""
        w = re.findall(r"[^ \t-\r]+", t)
        failed = {f for f, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t), i is not None and i > min(ids[t])), strict=True) if x}
        docs.append((lang or "", failed, i in good, i in toxic))
    want, shapley = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                out, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                shapley[part, f] += len(out)
                want[part, "".join(order), step] = (len(left), len(out), sum(f in d[1] for d in own) - len(out), sum(d[1] == {f} for d in own), sum(d[2] for d in out), sum(d[3] for d in out))
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.op12_filter_audit(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and "" in {k[0] for k in want}
    for k, x in want.items():
        r = got[k]
        assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) == (*x, shapley[k[0], k[1][k[2] - 1]])
    assert all(any(x[i] for x in want.values()) for i in range(6))
    assert filter_audit.op12_filter_audit(spark, empty_dir).count() == 0


def brute_hits(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    owners = collections.defaultdict(set)
    for name, text in items:
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            owners[tuple(w[i : i + window])].add(name or "")
    sizes = {len(x) for x in owners}
    out = []
    for i, text, *_ in rows:
        w = words(text)
        hit, found = set(), set()
        for m in sizes:
            for at in range(len(w) - m + 1):
                if tuple(w[at : at + m]) in owners:
                    hit |= set(range(at, at + m))
                    found |= owners[tuple(w[at : at + m])]
        out.append((i, len(w), len(hit), tuple(sorted(found, key=str.encode))))
    return out


def test_decontaminate(spark, sf_dir, empty_dir):
    rows, items = rows_with_passages()
    want = collections.Counter((i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x in brute_hits(rows, items))
    got = decontaminate.op13_decontaminate(spark, sf_dir).collect()
    assert collections.Counter(tuple(r) for r in got) == want and 10 < sum(r["contaminated"] for r in got) < len(got) // 2
    assert decontaminate.op13_decontaminate(spark, empty_dir).count() == 0


def test_decontaminate_in_small_shards_and_blocks(spark):
    """Texts longer than a shard, and several passes over blocks of items, give the same."""
    rows, items = rows_with_passages()
    rows = rows[-60:] + [(900, " ".join([rows[100][1]] + [t for _, t in items if t] * 3), "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("own"))
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    n_hit = F.aggregate(decontaminate.HITS, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    want = collections.Counter(brute_hits(rows, items))
    for size, most in ((50, 1 << 20), (1 << 20, 300), (30, 100)):
        found = decontaminate.decontaminate(docs, benchmark, shard_words=size, block_bytes=most)
        assert found.columns[: len(docs.columns)] == docs.columns
        got = found.select("doc_id", decontaminate.WORDS, n_hit, decontaminate.ITEMS).collect()
        assert collections.Counter((r[0], r[1], r[2], tuple(r[3])) for r in got) == want
    spans = found.select("text", decontaminate.SPANS, decontaminate.without_spans(F.col("text"), F.col(decontaminate.SPANS)).alias("kept")).collect()
    for r in spans:
        cuts = [(s["start"], s["stop"]) for s in r[1]]
        assert cuts == sorted(cuts) and r["kept"] == (r["text"] if not cuts else "".join(r["text"][a:z] for a, z in zip([0, *(z for _, z in cuts)], [*(a for a, _ in cuts), None], strict=True)))
        assert brute_hits([(0, None if not cuts else "|".join(r["text"][a:z] for a, z in cuts))], items)[0][2] == sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r["text"][a:z])) for a, z in cuts)


def test_no_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    got = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert [(r["doc_id"], r[decontaminate.WORDS], r[decontaminate.ITEMS], r[decontaminate.SPANS]) for r in got] == [(1, 3, [], []), (2, 0, [], [])]


@pytest.mark.parametrize("symbols", [1, 2, 5, 40, 3000])
def test_fm_index(symbols):
    rng = np.random.default_rng(symbols)
    s = np.append(rng.integers(1, symbols + 1, 1500), 0)
    s[300:600] = s[900:1200]
    order = fm_index.suffix_array(s)
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    index = fm_index.FMIndex(s, symbols + 1)
    patterns = np.array([s[i : i + 4] for i in rng.integers(0, 1490, 50)] + [[-1, -1, *s[7:9]], [symbols] * 4])
    low, high = index.search(patterns)
    for p, a, z in zip(patterns, low, high, strict=True):
        p = p[p >= 0].tolist()
        assert sorted(index.locate(np.arange(a, z)).tolist()) == [i for i in range(len(s)) if s[i : i + len(p)].tolist() == p]
