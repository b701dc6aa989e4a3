"""Operators 2, 4, 5, 6, 7 and 10 against brute force, over a corpus with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.helpers import corpus, saved, table

from attesta.llm import bpe, langid, line_dedup, mixing, quality, secret_scan, simhash, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY: list[tuple] = []


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    return saved(spark, tmp_path_factory.mktemp("docs"))


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    return saved(spark, tmp_path_factory.mktemp("empty"), EMPTY)


def multiset(rows):
    return collections.Counter(rows)


def test_quality_base(spark, sf_dir, empty_dir):
    def base(text):
        w = WORD.findall(text or "")
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)

    got = quality.op2_quality_rules(spark, sf_dir).collect()
    assert multiset((r["doc_id"], *r[1:7]) for r in got) == multiset((r[0], *base(r[1])) for r in corpus())
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality.op2_quality_rules(spark, empty_dir).count() == 0


def test_quality_rejects_what_lies_far_off(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(100 + i % 20)), "en", "a", 0) for i in range(200)]
    rows += [(1000 + i, " ".join(f"w{i}x{j}" + "#$%&" * (j % 2) for j in range(100)), "en", "a", 0) for i in range(5)]
    kept = {r["doc_id"]: r["__attesta_kept"] for r in quality.judge(table(spark, rows)).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[1000 + i] for i in range(5))


def test_simhash(spark, sf_dir, empty_dir):
    def fp(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(4, len(w))
        hs = [xxhash.xxh64(" ".join(w[i : i + k]).encode(), seed=42).intdigest() for i in range(len(w) - k + 1)] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    docs = [(r[0], fp(r[1])) for r in corpus()]
    fps = sorted({f for _, f in docs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, f in docs:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    got = simhash.op4_simhash_near_duplicates(spark, sf_dir).collect()
    assert multiset(map(tuple, got)) == multiset((d, f"{f:016x}", least.get(find(f))) for d, f in docs)
    assert simhash.op4_simhash_near_duplicates(spark, empty_dir).count() == 0


@pytest.mark.parametrize("hot", [1, 256])
def test_links_of_a_dense_cloud(spark, monkeypatch, hot):
    """With and without the way for hot keys, components are those of all pairs."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(3)
    fps = {0}
    for _ in range(60):
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.choice([3, 4, 5])):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(40)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 4)).collect()}
    assert {x: got.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_one_of_each_keeps_one_row_of_repeats(spark):
    rows = corpus()
    kept = simhash.one_of_each(table(spark, rows)).select("doc_id", "text").collect()
    assert len(kept) == len(set(kept)) and sum(r["text"] == rows[3][1] for r in kept) == 1 and len({r["text"] for r in kept}) == len(kept)


def brute_force_roots(rows, similarity=0.8):
    """(pairs at that similarity of five-word shingles, what is kept) of (id, text) with different ids."""
    def parts(t):
        ws = t.encode().lower().split()
        k = min(5, len(ws))
        return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}

    sets = [parts(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= similarity * (len(sets[i]) + len(sets[j]) - n):
                pairs += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return pairs, set(least.values())


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.getrandbits(40)}"
    return words


def kept_of(spark, rows):
    return [r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]


def test_one_of_each_finds_all_similar_pairs(spark):
    """Of ordinary texts with a few changed words, down to a similarity of 0.8."""
    rng, rows = random.Random(5), []
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(81, 725))]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join(edited(rng, words, max(1, len(words) * rng.randint(1, 3) // 100)))))
    pairs, want = brute_force_roots(rows)
    got = kept_of(spark, rows)
    assert pairs >= 40 and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("cloud", [4, 32])
def test_one_of_each_in_dense_groups(spark, monkeypatch, cloud):
    """Texts that are similar to each other but not to others of their bands, and one word set in other orders."""
    monkeypatch.setattr(simhash, "CLOUD", cloud)
    rng, rows = random.Random(8), []
    for f in range(5):
        # Two texts near a base that are similar to each other only; all the bands they share are those of the base, as are most of the others'.
        base = [f"w{f}-{i}" for i in range(150)]
        rows += [(100 * f + i, " ".join(edited(rng, base, {40: 1, 70: 2}.get(i, 4)))) for i in range(100)]
    vocabulary = [f"u{i}" for i in range(120)]
    for i in range(500, 560, 2):
        order = rng.sample(vocabulary, len(vocabulary))
        rows += [(i, " ".join(order)), (i + 1, " ".join([*order[1:], order[0]]))]
    pairs, want = brute_force_roots(rows)
    got = kept_of(spark, rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(rows)


def test_one_of_each_in_a_crowd_of_unlike_texts(spark, monkeypatch):
    """All texts share two thirds of their shingles, few pairs of them 0.8: at least nine of ten of these are found, and nothing else goes."""
    monkeypatch.setattr(simhash, "CLOUD", 8)
    rng, rows, template = random.Random(9), [], " ".join(f"t{i}" for i in range(300))
    for i in range(0, 400, 2):
        own = [f"o{rng.getrandbits(40)}" for _ in range(80)]
        rows += [(i, f"{template} {' '.join(own)}"), (i + 1, f"{template} {' '.join(edited(rng, own, 6) if i % 8 == 0 else [f'o{rng.getrandbits(40)}' for _ in own])}")]
    pairs, want = brute_force_roots(rows)
    got = kept_of(spark, rows)
    assert pairs >= 45 and want <= set(got) and len(got) - len(want) <= 0.1 * pairs


def test_language_id_learns_every_label(spark):
    """Forty labels, each with letters of its own; the rarest are learned as well."""
    from pyspark.sql import functions as F

    from attesta.llm import langid

    rows = [(f"l{i:02d}", " ".join(chr(0x4E00 + 10 * i + (j * k) % 10) * 3 for k in range(1, 8))) for i in range(40) for j in range(1, 2 + (i < 32))]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = langid.learn(docs, F.lit(True))
    assert model.languages == [f"l{i:02d}" for i in range(40)]
    assert langid.identify(docs, model).where("lang <> __attesta_lang").count() == 0


def test_bpe(spark, sf_dir, empty_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()

    def want(r):
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        h = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return r[0], len(ids), h(" ".join(map(str, ids))), h(t.decode(ids, skip_special_tokens=False))

    assert multiset(map(tuple, bpe.op5_bpe(spark, sf_dir).collect())) == multiset(map(want, corpus()))
    assert bpe.op5_bpe(spark, empty_dir).count() == 0
    definition = bpe.definition_of(path)
    ids = spark.createDataFrame([([320, 49407],), ([],), (None,), ([-1, 320, 10**6],)], "ids array<int>")
    got = [r["decoded"] for r in bpe.decode(ids, definition).collect()]
    assert got == [t.decode([320, 49407], skip_special_tokens=False), "", None, t.decode([320], skip_special_tokens=False)]


def test_bpe_words_outside_the_table(spark, sf_dir, monkeypatch):
    whole = multiset(map(tuple, bpe.op5_bpe(spark, sf_dir).collect()))
    monkeypatch.setattr(bpe, "TABLE_WORDS", 3)
    assert multiset(map(tuple, bpe.op5_bpe(spark, sf_dir).collect())) == whole


def test_language(spark, sf_dir, empty_dir):
    rows = corpus()
    got = langid.op6_language_id(spark, sf_dir).collect()
    assert multiset((r["doc_id"], r["held_out"]) for r in got) == multiset((r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    by_id = {r["doc_id"]: r for r in got}
    # Every seventh text has a passage in English, whatever its own language.
    clear = [r for r in rows[:90] if len(r[1]) > 200 and r[0] % 7]
    assert sum(by_id[r[0]]["lang_pred"] == r[2] for r in clear) >= 0.97 * len(clear)
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (95, 96, 97))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.op6_language_id(spark, empty_dir).count() == 0


def test_cross_parse_counts_greedy_phrases():
    """Exactly those of the whole text, however its blocks meet, and whatever is parsed beside it."""
    sample = {"x": "abcabd aaaaaaa", "y": "dcba bababab cd"}
    model = langid.fit({k: [v] for k, v in sample.items()})

    def greedy(text, known):
        n, phrase = 0, ""
        for ch in text:
            if phrase and phrase + ch in known:
                phrase += ch
            else:
                n, phrase = n + 1, ch if ch in known else ""
        return n

    rng = random.Random(6)
    texts = ["abcab", "dcbadcba", "zab", "a b", "", "abdabc" * 300, "a" * 5000, "ba" * 4000, "z" * 3000, "".join(rng.choice("abcd z") for _ in range(9000)), "ab" * langid.BLOCK + "c", "a" * langid.BLOCK, "b" * (langid.BLOCK + 1)]
    got, n, letters = langid.phrases(model, texts)
    for i, t in enumerate(texts):
        s = re.sub("[^a-z]+", " ", t)
        assert n[i] == len(s) and letters[i] == len(s.replace(" ", ""))
        assert got[i].tolist() == [greedy(s, sample[lang]) for lang in model.languages]


def test_language_model_of_many_letters_is_small():
    """The table follows the samples' lengths; states times letters would be 500 MB."""
    rng = random.Random(7)
    model = langid.fit({f"l{i}": ["".join(chr(0x4E00 + rng.randrange(1000) + 900 * i) for _ in range(4000))] for i in range(3)})
    assert model.base.nbytes + model.owner.nbytes + model.next.nbytes + model.begin.nbytes < 4 << 20


def test_secrets(spark, sf_dir, empty_dir):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)

    def want(r):
        t = r[1] or ""
        s = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(s))
        return r[0], *(sum(k == i for _, k, _ in s) for i in range(3)), hashlib.sha256(listed.encode()).hexdigest()

    got = secret_scan.op7_secret_scan(spark, sf_dir).collect()
    assert multiset((r["doc_id"], *r[1:5]) for r in got) == multiset(map(want, corpus()))
    added = [r for r in got if "random" in r["spans"]]
    assert {r["doc_id"] for r in added} == {i for i in range(90) if i % 13 == 0}
    assert secret_scan.op7_secret_scan(spark, empty_dir).count() == 0


def test_random_runs_and_structured_ones(spark):
    import base64
    rng = random.Random(5)
    secrets = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(20)]
    plain = ["AbstractSingletonProxyFactoryBean2", "this-is-a-long-hyphenated-word-1", "2024-01-01-2024-02-02-2024-03-03", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa1A", "src/main/java/com/acme/App1Main"]
    docs = spark.createDataFrame([(i, f"x {s} y") for i, s in enumerate(secrets + plain)], "doc_id int, text string")
    slim, spans = secret_scan.find(docs)
    added = F.exists("spans", lambda s: s["kind"] == secret_scan.NAMES.index("random"))
    found = {r["doc_id"] for r in slim.join(spans, slim["__attesta_key"] == spans["key"]).where(added).collect()}
    assert len(found & set(range(20))) >= 18 and not found & set(range(20, 25))


def test_discoveries_are_those_of_the_battery(spark):
    """Random runs among a thousand structured ones, against a plain computation of the three tests and the control."""
    import base64

    rng = random.Random(9)
    words = "alpha beta gamma delta cache proxy bean factory Main Test App user order index value".split()
    plain = ["".join(w.capitalize() for w in rng.choices(words, k=rng.randint(4, 9))) + str(rng.randrange(100)) for _ in range(700)]
    plain += ["/".join(rng.choices(words, k=6)) + f"/App{i}" for i in range(300)] + ["Aa1" * 9, "x" * 30 + "A1", "AB" * 20 + "cd"]
    secret = [base64.b64encode(rng.randbytes(rng.choice([33, 36, 48]))).decode() for _ in range(60)] + ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=52)) for _ in range(20)]
    bodies = list(dict.fromkeys(plain + secret))
    rows = [(i, f"see {b} here", "t") for i, b in enumerate(bodies)]
    slim, spans = secret_scan.find(spark.createDataFrame(rows, "doc_id int, text string, body string"))
    added = F.exists("spans", lambda s: s["kind"] == secret_scan.NAMES.index("random"))
    got = {bodies[r["doc_id"]] for r in slim.join(spans, slim["__attesta_key"] == spans["key"]).where(added).collect()}

    def tested(body):
        run = body.rstrip("=")
        enc = next((e for e, (p, _) in secret_scan.ENCODINGS.items() if re.search(p, run)), None)
        if enc is None or len(run) < 20:
            return None
        n, k = len(run), secret_scan.RADIX[enc]
        letters = secret_scan.ENCODINGS[enc][1]
        counts = collections.Counter(run)
        chi = k / n * sum(x * x for x in counts.values()) - n
        df, beyond = k - 1, n * (secret_scan.STRUCTURE[0] - 1)
        kinds = ["U" if x.isupper() else "L" if x.islower() else "D" if x.isdigit() else "O" for x in run]
        sizes = collections.Counter(kinds).values()
        s2, s3 = sum(x**2 for x in sizes), sum(x**3 for x in sizes)
        runs = 1 + sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
        spread = (s2 * (s2 + n * (n + 1)) - 2 * n * s3 - n**3) / (n * n * (n - 1))
        x = [letters.index(ch) + 1 for ch in run]
        d = [v - sum(x) / n for v in x]
        var = sum(v * v for v in d)
        r = abs(sum(a * b for a, b in zip(d, d[1:], strict=False)) / var) if var else 1
        z1 = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
        z2 = (runs - 1 - n + s2 / n) / math.sqrt(spread) if spread > 1e-9 else 0
        z3 = ((r * math.sqrt(n) if var else 99) - 0.8) / 0.6
        t1 = (chi - df - beyond) / math.sqrt(2 * df + 4 * beyond)
        t2 = -(runs - 1 - secret_scan.STRUCTURE[1] * (n - s2 / n)) / math.sqrt(spread) if spread > 1e-9 else -99
        t3 = (r - secret_scan.STRUCTURE[2]) * math.sqrt(n)
        p = max(math.erfc(-t / math.sqrt(2)) / 2 for t in (t1, t2, t3))
        return body, sum(n >= x for x in secret_scan.STRATA), p, (z1 - z2 + z3) / math.sqrt(3)

    strata = collections.defaultdict(list)
    for x in filter(None, map(tested, bodies)):
        strata[x[1]].append(x)
    want = set()
    for found in strata.values():
        ranked = sorted(found, key=lambda x: x[2])
        most = max((i for i, x in enumerate(ranked, 1) if x[2] <= secret_scan.FDR * i / len(ranked)), default=0)
        want |= {b for b, _, _, z in ranked[:most] if z <= secret_scan.MOST_Z}
    # The operator's p-values are those of a close formula, in steps of a hundredth of a decimal.
    assert len(got ^ want) <= 3
    assert len(got & set(secret)) >= 0.9 * len(secret) and len(got - set(secret)) <= 0.03 * len(got)


def test_mixing(spark, sf_dir, empty_dir):
    rows = corpus()
    sizes = [(r[0], r[3], len(WORD.findall(r[1] or ""))) for r in rows]
    total = collections.Counter()
    for _, s, n in sizes:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, budget = {}, set(order), float(sum(total.values()))
    while free:
        share = {s: budget * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            budget -= target[s]
        free -= over
    got = mixing.op10_mix_sources(spark, sf_dir).collect()
    assert multiset((r["doc_id"], r["size"]) for r in got) == multiset((d, n) for d, _, n in sizes)
    known = collections.defaultdict(set)
    for d, s, n in sizes:
        known[d, n].add(s)
    taken = collections.Counter()
    for r in got:
        s = next(iter(known[r["doc_id"], r["size"]]))
        assert math.isclose(r["target"], target[s], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == total[s] and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    longest = {s: max(n for _, x, n in sizes if x == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= longest[s] + 1 for s in order)
    assert multiset(map(tuple, got)) == multiset(map(tuple, mixing.op10_mix_sources(spark, sf_dir).collect()))
    assert mixing.op10_mix_sources(spark, empty_dir).count() == 0


def test_mixing_in_many_buckets(spark, sf_dir, monkeypatch):
    one = multiset(map(tuple, mixing.op10_mix_sources(spark, sf_dir).select("doc_id", "taken", "target").collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert multiset(map(tuple, mixing.op10_mix_sources(spark, sf_dir).select("doc_id", "taken", "target").collect())) == one


def test_mix_takes_what_the_queue_takes(spark, sf_dir):
    """All copies in order of finish time, one after the other until the budget is spent."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size, key = mixing.sized_documents(docs)
    rows = [tuple(r) for r in docs.select("doc_id", "source", size, F.shiftrightunsigned(key, 1), "text").collect()]
    got = mixing.mix(docs, size, key)
    target = {r["source"]: r["t"] for r in got.groupBy("source").agg(F.max("__attesta_target").alias("t")).collect()}
    whole = collections.Counter()
    for _, s, n, _, _ in rows:
        whole[s] += n
    queue = []
    for s in whole:
        cum = 0
        for i, (_, x, n, k, _) in sorted(((i, r) for i, r in enumerate(rows) if r[1] == s), key=lambda x: x[1][3]):
            cum += n
            if n:
                queue += [((e * whole[s] + cum) / target[s], s is None, s or "", k, i) for e in range(3)]
    copies, spent, budget = collections.Counter(), 0, round(sum(target.values()), 3)
    for *_, i in sorted(queue):
        spent += rows[i][2]
        if spent > budget:
            break
        copies[i] += 1
    want = multiset((r[0], r[1], r[4], copies[i]) for i, r in enumerate(rows))
    assert multiset((r["doc_id"], r["source"], r["text"], r["__attesta_copies"]) for r in got.collect()) == want
    ordered = mixing.in_order(got)
    times = [r["__attesta_finish"] for r in ordered.collect()]
    assert len(times) == sum(copies.values()) and times == sorted(times) and set(docs.columns) <= set(ordered.columns)


def test_operators_keep_columns_of_any_name(spark):
    docs = table(spark)
    assert set(docs.columns) <= set(langid.identify(docs, langid.fit({"en": ["the"]})).columns)
    assert set(docs.columns) <= set(mixing.mix(docs, F.length("text"), F.xxhash64("text")).columns)
    assert set(docs.columns) - {"text"} <= set(simhash.group(docs).columns)
    own = [x for x in docs.columns if x not in ("doc_id", "text", "lang", "source", "n_chars")]
    for out in (line_dedup.dedup(docs), secret_scan.find(docs)[0], url_filter.judge(docs, "text"), mixing.in_order(mixing.mix(docs, F.length("text"), F.xxhash64("text")))):
        assert set(own) <= set(out.columns) and out.where(F.concat(*own) != "own" * len(own)).count() == 0


def test_bpe_words_are_decoded_by_a_join(spark):
    import public_tokenizers

    definition = bpe.definition_of(public_tokenizers.path("word_bpe_49k.json"))
    t = bpe.tokenizer(definition)
    words = ["the", "unbelievable", "é한", "́x", "<|endoftext|>", "a"]
    df = spark.createDataFrame([(w, t.encode(w, add_special_tokens=False).ids) for w in words] + [("none", [])], "word string, ids array<int>")
    got = {r["word"]: r["text"] for r in bpe.decoded_words(df, definition).collect()}
    assert got == {w: t.decode(t.encode(w, add_special_tokens=False).ids, skip_special_tokens=False) for w in words} | {"none": ""}


def test_pipeline_drops_what_fingerprints_link(spark):
    """Two texts of a similarity under 0.8 whose fingerprints differ in at most four bits: operator 4 links them, and so does the pipeline's stage."""
    import corpus_pipeline

    rng = random.Random(11)
    while True:
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        pair = [" ".join(words), " ".join(edited(rng, words, 8))]
        a, b = (simhash.fingerprint(x, 4) for x in pair)
        if ((a ^ b) % (1 << 64)).bit_count() <= 4 and brute_force_roots(list(enumerate(pair)))[0] == 0:
            break
    rows = [(1, pair[0]), (2, pair[1]), (3, "another text of a few words"), (4, None), (None, pair[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3, 4]


def test_bpe_table_is_columns_in_a_worker(spark):
    """Rows of words in and beyond the table, empty and null ones: ids and texts as the library's; what is broadcast holds no object for each word."""
    import public_tokenizers

    definition = bpe.definition_of(public_tokenizers.path("word_bpe_49k.json"))
    t = bpe.tokenizer(definition)
    texts = ["the cat the dog", "", None, " \t\n", "zqxj中文 the \U0001f600", "the été the"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id int, text string")
    table = bpe.word_table(docs, definition)
    sent = []
    real = type(spark.sparkContext).broadcast
    try:
        type(spark.sparkContext).broadcast = lambda self, x: sent.append(x) or real(self, x)
        got = {r["doc_id"]: r for r in bpe.encode(docs, definition, table, decoded="decoded").collect()}
    finally:
        type(spark.sparkContext).broadcast = real
    assert b"the" in table and all(isinstance(x, (str, bytes)) for x in sent[0])
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == t.decode(ids, skip_special_tokens=False)
