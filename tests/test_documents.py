import difflib
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as t
from attesta.functions import urls
from attesta.operators import citations, corpus, documents, ingest, references
from attesta.plans import rules
from attesta.sources import readers, sinks
from attesta.streaming import incremental

DRAFT = "# T\nBody [S1] [{0}].\n## 参考文献\n[S1] One. {1}\n{2}"


def drafts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_closure(spark):
    url = "https://a.org"
    got = {r["doc_id"]: r for r in citations.closure(drafts(spark, DRAFT.format("S1", url, ""), DRAFT.format("S3", url, ""), DRAFT.format("S1", url, f"[S2] Two. {url}"), DRAFT.format("S1", "none", ""), "no sections", "", None)).collect()}
    assert got[0]["passed"] and got[1]["orphaned"] == ["3"] and got[2]["unused"] == ["2"] and got[3]["missing_urls"] == ["S1"]
    assert got[4]["passed"] and got[5]["passed"]
    few = citations.closure(drafts(spark, DRAFT.format("S1", url, "")), 5, 50000).first()
    assert few["few_sources"] and few["thin"] and not few["passed"]


def test_links_are_no_markers_and_order_is_textual(spark):
    body, refs, _ = citations.refs_boundary_last(F.col("text"))
    d = drafts(spark, "[S10] [S2] [S1](u) 〔S3〕\n## 参考文献\n[S2] b\n[S10] a").withColumns({"body": body, "refs": refs})
    assert d.select(citations.markers("body", t.SOURCE_MARK)).first()[0] == ["10", "2"]


def test_last_heading_and_appendix_before_references(spark):
    d = citations.split_drafts(drafts(spark, "a\n## 参考文献\nold\n## 2. 参考文献\nnew\n## 附录A\nx", "a\n## 附录A\nx\n## 参考文献\ny", "## 参考文献\nfirst line counts as none"))
    got = [(r["body"], r["refs"], r["appendix"]) for r in d.collect()]
    assert got[0] == ("a\n## 参考文献\nold", "## 2. 参考文献\nnew", "## 附录A\nx")
    assert got[1][1] == "" and got[2][1] == ""


def test_numeric_closure(spark):
    ok, bad = citations.numeric_closure(drafts(spark, "a [1] （2）\n## 参考文献\n[1] x\n[2] y", "a [1] [3]\n## 参考文献\n[1] x\n[2] y\n[4] z")).orderBy("doc_id").collect()
    assert ok["passed"] and (bad["orphaned"], bad["unused"], bad["gaps"]) == ([3], [2, 4], [3])


def test_finished_text(spark):
    text = "# T\n[S7] [S1] [S10] [S9] [G2][假设]<!-- x -->\n\n\n\nend\n## 参考文献 References\n[S1] One. https://a\n[S7] Seven. https://a\n[S10] Ten.\n## 附录A 证据缺口\n| [G2] | what is missing | high |\n| [G3] | other | low |"
    d = citations.finished(drafts(spark, text))
    final = d.first()["final"]
    assert final.startswith("# T\n[2] [1] [3] [?9] \n\nend\n\n## 研究局限\n\n") and "2. what is missing\n\n## 参考文献" in final and "other" not in final and final.endswith("[3] Ten.\n")
    assert {r["problem"] for r in citations.final_problems(d).collect()} == {"residual [?n]: 1", "duplicate URL: https://a"}


def test_framework_depth(spark):
    text = "## 第一章 绪论\n短\n## 第二章 设计\n### 总体目标\n### 方法\n### 输入\n### 标准\n正文\n## 3. 薄\n无"
    got = {r["title"]: r for r in documents.framework_depth(drafts(spark, text), min_chars=10).collect()}
    assert set(got) == {"设计", "薄"} and got["设计"]["passed"] and len(got["薄"]["missing"]) == 4
    assert not documents.framework_depth(drafts(spark, text)).where("passed").count()


def test_sections(spark):
    text = "# Title\n摘要：中文\nAbstract: English one\nKey words: a; b\n## 0 引言\n正文\n## 附录\n略\n## 2 结论\n（1）好\n参考文献\n[1] 甲. 题[J].\n   Jia. Title[J].\n[2] 乙"
    r = documents.with_sections(drafts(spark, text)).first()
    assert (r["abs"], r["abs_en"], r["kw_en"]) == ("中文", "English one", "a; b")
    assert r["body"].startswith("## 0 引言") and "略" not in r["body"] and "（1）好" in r["concl"]
    assert documents.with_sections(drafts(spark, text)).select(documents.entries(F.col("refs"))).first()[0] == ["[1] 甲. 题[J]. Jia. Title[J].", "[2] 乙"]


def test_sections_read_a_line_once(spark):
    """A long line's patterns are tried once each, not once for each way through the fold; sections stay the same."""
    text = "# T\r\n摘要：" + "中" * 160 + "\r## 引言\nKey words: a\n中图分类号：TM7\n" + "正文" * 40 + "，无分隔的长行引言\n## 1 结论\n好\nReferences\n[1] 甲"
    r = documents.with_sections(drafts(spark, text)).first()
    assert r["abs"] == "中" * 160 and r["kw_en"] == "a" and r["concl"].endswith("好") and r["refs"] == "[1] 甲"
    assert r["front"] == "# T\n中图分类号：TM7" and r["body"] == "## 引言\n" + "正文" * 40 + "，无分隔的长行引言"
    plan = documents.with_sections(drafts(spark, text))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("结论|结语") == 1 and plan.count("{2,6}") == 1


def test_urls(spark):
    hosts = ["https://8.8.8.8/x", "http://127.0.0.1", "http://10.1.1.1", "http://192.168.1.1", "http://169.254.1.1", "ftp://a.org", "file:///x", "http://localhost", "http://a.local", "https://a.example", "https://www.example", "https://public.com"]
    df = spark.createDataFrame([(x,) for x in hosts], "u string")
    got = [r[0] for r in df.select(urls.policy(F.col("u"))).collect()]
    assert [x is None for x in got] == [True, *[False] * 10, True]
    six = spark.createDataFrame([("::1",), ("[fe80::1]",), ("2606:4700::1111",), ("x",)], "h string")
    assert [r[0] for r in six.select(urls.private_ip(F.col("h"))).collect()] == [True, True, False, None]


def test_quote_hash_ignores_layout(spark):
    df = spark.createDataFrame([("a  b\n c",), ("　a b c ",)], "q string")
    a, b = [r[0] for r in df.select(t.quote_hash(F.col("q"))).collect()]
    assert a == b and a.startswith("sha256:")


def test_corpus_problems(spark):
    rows = [("c", 0, "S1", "t", None, "https://x", "ok", "A1", "current", None, "x"), ("c", 1, "S1", None, None, "https://wikipedia.org", None, "E5", "superseded", "hacker", "x"), ("c", 2, " ", "t", None, None, None, None, None, None, None), ("c", 3, "S3", "t", None, "https://x", "ok", None, None, None, "x")]
    df = spark.createDataFrame(rows, "case_id string, pos int, source_id string, title string, title_or_name string, url string, access_status string, authority string, freshness string, source_origin string, type string")
    got = sorted((r["source_id"], r["problem"]) for r in corpus.problems(df, quota=10).collect())
    assert got == sorted([("", "empty_id"), ("S1", "duplicate_id"), ("S1", "missing_title"), ("S1", "suspect_domain"), ("S1", "empty_access_status"), ("S1", "illegal_authority"), ("S1", "superseded"), ("S1", "illegal_origin"), ("S3", "missing_authority"), ("S3", "missing_freshness"), ("", "duplicate_url"), ("", "journal_quota")])


def test_rules(tmp_path):
    assert rules.doc_minimum(rules.load_rules(), "thesis_phd") == (60, 35000)
    assert rules.doc_minimum(rules.load_rules(profile="general_tech"), "proposal") == (10, 4000)
    assert rules.load_rules(profile="medical")["risk_tiers"]["R3"]["authority_min"] == "A1"
    assert "jianshu.com" in rules.effective_suspect_domains(rules.load_rules(profile="medical")) and "jianshu.com" not in rules.effective_suspect_domains(rules.load_rules())
    (tmp_path / "r.yaml").write_text("doc_minimums:\n  proposal:\n    min_sources: 99  # more\nsuspect_domains:\n  - a\n  - \"b#c\"\nflags: [x, 2, true]\n")
    got = rules.load_rules(tmp_path / "r.yaml")
    assert rules.doc_minimum(got, "proposal") == (99, 6000) and got["suspect_domains"] == ["a", "b#c"] and got["flags"] == ["x", 2, True]
    assert rules.thresholds(rules.load_rules(), "conservative")["R4"] == (3, 3)
    # Rounding up makes the lenient mode ask for as much as the balanced one.
    assert rules.thresholds(rules.load_rules(), "exploratory") == rules.thresholds(rules.load_rules(), "balanced")
    with pytest.raises(KeyError):
        rules.load_rules(profile="none")


def test_title_mismatch_is_difflibs(spark):
    pairs = [("a small red ring", "an unrelated heading"), ("blue", "blue. Publisher"), ("abcdef", "abcxyz")]
    e = spark.createDataFrame([(1, f"S{i}", f"[S{i}] {b}. x") for i, (_, b) in enumerate(pairs)], "doc_id int, source_id string, entry string")
    s = spark.createDataFrame([(f"S{i}", a) for i, (a, _) in enumerate(pairs)], "source_id string, title string")
    got = {r["source_id"]: r["score"] for r in ingest.title_mismatches(e, s).collect()}
    want = {f"S{i}": max(difflib.SequenceMatcher(None, x, a).ratio() for x in (f"{b}. x".lower(), b.split(". ")[0].lower())) for i, (a, b) in enumerate(pairs)}
    assert got == {k: v for k, v in want.items() if v < 0.6}


def test_addresses_like_the_standard_library(spark):
    """Random and odd IPv6 and IPv4 addresses; shared and site-local networks are blocked beyond it."""
    rng = random.Random(6)
    heads = ["2001:", "2001:db8:", "2002:", "2606:", "fd00:", "fe80:", "ff02:", "2001:20:", "2001:4:112:", "2001:1::", "64:ff9b::", "::ffff:", "::", "100::", "5f00:", "2a00:", "2001:3:", "2001:30:", "2001:2:", "2001:1ff:", "2001:200:"]
    six = {h.rstrip(":") + "::" + f"{rng.randrange(1 << 16):x}" if "::" not in h else h + f"{rng.randrange(1 << 16):x}" for h in heads for _ in range(6)} | {"2001:1::1", "2001:1::2", "2001:1::3", "::", "::1", "1:2:3:4:5:6:7:8", "2001:0db8:0:0:0:0:0:1", "::ffff:8.8.8.8", "64:ff9b::10.0.0.1", "2002:7f00:1::", "FE80::1"}
    four = {".".join(str(rng.choice([0, 8, 9, 10, 127, 169, 172, 192, 203, 254, 255, rng.randrange(256)])) for _ in range(4)) for _ in range(200)} | {"192.0.0.9", "192.0.0.10", "192.0.0.11", "100.63.0.1"}
    hidden = lambda a: a.is_private or a.is_reserved or a.is_multicast or a.is_link_local or a.is_unspecified
    d = spark.createDataFrame([(x,) for x in six | four], "h string").where(~F.col("h").rlike("^100[.](6[4-9]|[7-9]|1[01]|12[0-7])"))
    for r in d.select("h", urls.private_ip(F.col("h")).alias("p")).collect():
        assert r["p"] == hidden(ipaddress.ip_address(r["h"])), r
    odd = {"1:2:3": True, ":::": True, "12345::": True, "1::2::3": True, "g::": True, "[::1]": True, "[2606::1%eth0]": False, "host.org": None, "1.2.3": None}
    assert {r["h"]: r["p"] for r in spark.createDataFrame([(x,) for x in odd], "h string").select("h", urls.private_ip(F.col("h")).alias("p")).collect()} == odd
    numbers = {"2130706433": True, "127.1": True, "0x7f.1": True, "0177.0.0.1": True, "134744072": False, "8.8.2056": False, "0x08.010.8.8": False, "4294967296": True, "1.256.1.1": True, "1.2.65536": True, "09.1.1.1": True, "99999999999999999999999": True, "0": True, "a.1": None, "0xg": None}
    assert {r["h"]: r["p"] for r in spark.createDataFrame([(x,) for x in numbers], "h string").select("h", urls.numeric_host(F.col("h")).alias("p")).collect()} == numbers
    reasons = spark.createDataFrame([(f"http://{x}/",) for x in ("[2002:7f00:1::]", "2130706433", "127.1", "8.8.8.8", "134744072", "[::ffff:8.8.8.8]", "[2001:20::1]")], "u string").select(urls.policy(F.col("u"))).collect()
    assert [r[0] for r in reasons] == ["private_ip", "private_ip", "private_ip", None, None, "private_ip", None]


def test_title_bounds_hold(spark):
    """Bounds of random titles enclose difflib's ratio, and decide most pairs; the ids are those of the scores."""
    rng = random.Random(5)
    words = ["cable", "ageing", "of", "the", "état", "研究", "a", "reactor", "Series", "No.", "x" * 30, "é"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
    pairs = []
    for i in range(400):
        t = title()
        shown = rng.choice([t, title(), t[: len(t) // 2] + title(), t.upper() + ". Publisher", t + " " + title(), "", "a" * 250 + t])
        pairs.append((i, f"S{i}", f"[S{i}] {shown}. https://x.org", t, rng.choice([t, None, "", title()])))
    d = spark.createDataFrame(pairs, "doc_id int, source_id string, entry string, title string, title_or_name string")
    entries, sources = d.select("doc_id", "source_id", "entry"), d.select("source_id", "title", "title_or_name")
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    p = ingest.title_pairs(entries, sources)
    bounds = {x: ingest.ratio_bounds(F.col(x), F.col("known")) for x in ("whole", "first")}
    rows = p.select("*", *[c.alias(f"{x}{i}") for x, b in bounds.items() for i, c in enumerate(b)]).collect()
    want = set()
    for r in rows:
        true = {x: ratio(r[x], r["known"]) for x in bounds}
        assert all(r[f"{x}0"] - 1e-9 <= true[x] <= r[f"{x}1"] + 1e-9 for x in bounds), r
        if max(true.values()) < 0.6:
            want.add(r["source_id"])
        assert r["unlike"] is None or r["unlike"] == (max(true.values()) < 0.6)
    assert {r["source_id"] for r in ingest.mismatched_ids(entries, sources).collect()} == want == {r["source_id"] for r in ingest.title_mismatches(entries, sources).collect()}
    assert len(want) > 50 and sum(r["unlike"] is None for r in rows) < len(rows) / 3
    known = {r["source_id"]: r["known"] for r in rows}
    assert all(known.get(s, "") == " ".join((n or "").split() or t.split()).lower().rstrip(".").strip() for _, s, _, t, n in pairs if s in known)


def test_each_different_entry_is_compared_once(spark, monkeypatch):
    entries = spark.createDataFrame([(i, f"S{i % 2}", f"[S{i % 2}] Grid study. https://x.org") for i in range(40)] + [(0, "S0", "[S0] Wholly unlike words. https://x.org"), (0, "S0", "[S0] Grid study. https://x.org")], "doc_id int, source_id string, entry string")
    sources = spark.createDataFrame([("S0", "Grid study"), ("S1", "Another matter"), ("S1", "Another thing")], "source_id string, title string")
    compared, pairs = [], ingest.title_pairs
    monkeypatch.setattr(ingest, "title_pairs", lambda e, *rest: compared.append(e.count()) or pairs(e, *rest))
    got = [tuple(r) for r in ingest.mismatched_ids(entries, sources).collect()]
    assert compared == [3] and sorted(got) == sorted([(i, "S1") for i in range(1, 40, 2)] * 2 + [(0, "S0")])


def test_overuse_counts_level_c_alone(spark):
    drafts = spark.createDataFrame([("a", "[S1] [S1] [S2] [S2] [S3]"), ("a", "[S1]")], "doc_id string, text string")
    levels = spark.createDataFrame([("1", "C"), ("2", "B"), ("3", "C")], "ref string, level string")
    found = citations.overused(drafts, levels, threshold=2)
    assert [tuple(r) for r in found.select("doc_id", "ref", "n").collect()] == [("a", "1", 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


def test_title_entries_begin_after_a_blank_line(spark):
    d = spark.createDataFrame([(1, "## 参考文献\n\n[S1] One\n[S2] Two\n\n[S3] Three. x\n\nplain\n\n[4] no")], "doc_id int, refs string")
    assert {r["source_id"]: r["entry"] for r in citations.title_entries(d).collect()} == {"S1": "[S1] One\n[S2] Two", "S3": "[S3] Three. x\n\nplain"}


def test_splice_keeps_a_numbered_heading(spark):
    df = spark.createDataFrame([("a\n## 13. 参考文献\nold\n## 附录A\nx", "## 参考文献\n\nnew\n"), ("a", "## 参考文献\n\nnew\n")], "t string, s string")
    got = [r[0] for r in df.select(references.spliced(F.col("t"), F.col("s"))).collect()]
    assert got == ["a\n## 13. 参考文献\n\nnew\n## 附录A\nx", "a\n\n## 参考文献\n\nnew\n"]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_bytes("中文".encode("gb18030"))
    (tmp_path / "d" / "b.md").write_text("中文")
    assert {r["text"] for r in readers.drafts(spark, str(tmp_path / "d")).collect()} == {"中文"}
    (tmp_path / "r.json").write_text(json.dumps({"writingSourceList": {"authoritativeSources": [{"id": "iaea", "category": "x", "allowFullText": True}]}}))
    assert corpus.ranked(readers.registry(spark, str(tmp_path / "r.json"))).first()["priority"] == 100
    assert readers.capped(iter(["a", "b", "c"]), max_pages=2) == ("a\n\nb", True) and readers.capped(iter(["abc"]), max_chars=2) == ("ab", True)
    bad = readers.pdf_texts(spark.createDataFrame([("x", b"no pdf")], "path string, content binary")).first()
    assert bad["error"] and bad["chars"] == 0
    row = spark.createDataFrame([("S1", "t", None, None, "failed", None, None, None, "r", "f")], ", ".join(f"{c} string" for c in sinks.DOWNLOAD_COLUMNS))
    sinks.download_manifest(row, str(tmp_path / "out"))
    csv = [p.read_text() for p in (tmp_path / "out" / "csv").glob("*.csv")]
    assert all(x.startswith("\ufeffid,title") for x in csv) and any("failed" in x for x in csv)
    assert json.loads(sinks.audit_log(row, "t", "p").first()["value"])["entries"][0]["status"] == "failed"


def test_stream_of_changes(spark, tmp_path):
    claims = spark.createDataFrame([(1, "C-1", "R1", "E", "live", True), (2, "C-2", "R1", "E", "live", True)], "claim_key int, claim_id string, risk string, claim_class string, verification_mode string, covered boolean")
    sources = spark.createDataFrame([(1, "A1", "current", "u")], "source_key int, authority string, freshness string, url string")
    evidence = spark.createDataFrame([(1, 1, "direct", "supports", 1)], "claim_key int, source_key int, support_level string, relation string, page int")
    spark.createDataFrame([("C-1",)], "claim_id string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("claim_id string").json(str(tmp_path / "in"))
    q = incremental.recheck(stream, lambda: (claims, sources, evidence), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [(r["claim_id"], r["passed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("C-1", True)]


def test_registry_has_an_oracle_for_nearly_all():
    from attesta import queries

    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) - len(queries.oracle_sql()) <= 1


def test_addresses_that_are_not_public(spark):
    import ipaddress

    from attesta.functions import urls

    hosts = ["::1", "[::1]", "fd00::1", "[fe80::1]", "ff02::1", "::", "2001:db8::1", "2606:2800:220:1::1", "[2a00:1450:4001::200e]", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "10.1.2.3", "172.32.0.1", "8.8.8.8", "100.64.0.1", "2001:4860:4860::8888", "fec0::1", "64:ff9b::1"]

    def want(h):
        # An IPv4 address within an IPv6 one is reserved, whatever it is.
        ip = ipaddress.ip_address(h.strip("[]"))
        return not ip.is_global or ip.is_multicast or ip.is_reserved or getattr(ip, "is_site_local", False)

    got = {r["h"]: r["p"] for r in spark.createDataFrame([(h,) for h in hosts], "h string").withColumn("p", urls.private_ip(F.col("h"))).collect()}
    assert got == {h: want(h) for h in hosts}
    names = spark.createDataFrame([("host.org",), ("fd00.org",), ("1.2.3",)], "h string").withColumn("p", urls.private_ip(F.col("h")))
    assert {r["p"] for r in names.collect()} == {None}
    rows = [("http://[::1]:8080/", None, "private_ip"), ("http://[fd00::1]/", None, "private_ip"), ("https://a.org/x", ["8.8.8.8"], None), ("https://a.org/x", ["8.8.8.8", "10.0.0.1"], "private_ip"), ("ftp://a.org/", None, "scheme"), ("http://box.local/", None, "blocked_host")]
    df = spark.createDataFrame(rows, "u string, a array<string>, w string").withColumn("p", urls.policy(F.col("u"), answers=F.col("a")))
    assert [r["p"] for r in df.collect()] == [w for *_, w in rows]
    hops = spark.createDataFrame([(["https://a.org/", "http://[::1]/"],), (["https://a.org/"],)], "hops array<string>")
    assert [r["p"] for r in hops.withColumn("p", urls.hops_policy(F.col("hops"))).collect()] == ["private_ip", None]


def test_unknown_domain_is_an_error(spark):
    import pytest

    from attesta.operators import corpus

    rows = spark.createDataFrame([("a", "n", "education_research", "u", True), ("b", "n", "other", "u", True)], "id string, name string, category string, url string, allowFullText boolean")
    assert [r["id"] for r in corpus.selected(rows, "education").collect()] == ["a"] and corpus.selected(rows, "general").count() == 2
    with pytest.raises(ValueError, match="unknown topic domain"):
        corpus.selected(rows, "astrology")


def test_first_page(spark):
    pages = [
        ("核电缆\n某大学\n多源数据融合的\n电缆老化评估方法\n王小明1，李大山2\n摘要：本文。\n多源数据融合的电缆老化评估方法", "多源数据融合的电缆老化评估方法", "王小明，李大山"),
        ("Deep Networks for Cable Ageing\nA Review of Methods\nabstract: text", "Deep Networks for Cable Ageing A Review of Methods", ""),
        ("。\n，", "", ""), ("", "", ""),
        ("这是一个没有重复而且长度超过四十个字符因此绝不会被当作标题来使用的首屏正文长句它还在继续下去直到足够", "", ""),
    ]
    got = spark.createDataFrame([(i, p) for i, (p, *_) in enumerate(pages)], "i int, p string").withColumn("x", ingest.title_and_authors(F.col("p"))).orderBy("i").collect()
    assert [(r["x"]["title"], r["x"]["authors"]) for r in got] == [tuple(w) for _, *w in pages]
    fields = {k: v.alias(k) for k, v in ingest.bibliography(F.col("p")).items()}
    rows = spark.createDataFrame([("文章编号：1001-2019(05)-00123-08 DOI：10.1234/ab.c.",), ("Journal of Cable Studies Vol. 12 No. 3 March 2015",), ("x",)], "p string").select(*fields.values()).collect()
    assert (rows[0]["doi"], rows[0]["year"], rows[0]["issue"], rows[0]["page"]) == ("10.1234/ab.c", "2019", "5", "123-130")
    assert (rows[1]["journal"], rows[1]["volume"], rows[1]["issue"], rows[1]["year"]) == ("Journal of Cable Studies", "12", "3", "2015")
    assert all(rows[2][x] == "" for x in ("doi", "journal", "volume", "issue", "page", "year"))


def test_metadata_of_the_head_only(spark):
    """Another paper's DOI and year further down say nothing; a running head has the title; a journal within the title is none."""
    tail = "x\n" * 50 + "DOI:10.9999/other.1 别的学报 2015，3(4) March 2015\n"
    pages = [
        ("10.1234/bare\n" + tail, "", {"doi": "", "year": "", "journal": "", "volume": "", "lang": "en"}), ("DOI 10.1234/x,\n仪器学报 2021，40(9)\n" + tail, "", {"doi": "10.1234/x", "journal": "仪器学报", "volume": "40", "issue": "9", "year": "2021", "lang": "zh"}),
        ("仪器学报 2021，40(9)\n", "论仪器学报之法", {"journal": "", "volume": "", "year": "", "lang": "zh"}), ("第 3 卷 第 4 期\n□电 工 学报■\n，2019，", "", {"journal": "电工学报", "volume": "3", "issue": "4", "year": "2019"}),
        ("Some Journal Vol.3 No.4 June 2014", "", {"journal": "Some Journal", "volume": "3", "issue": "4", "year": "2014"}), ("1998 年\n2003年", "", {"year": "2003"}), (None, None, {}),
    ]
    d = spark.createDataFrame([(i, p, x) for i, (p, x, _) in enumerate(pages)], "i int, p string, x string")
    got = d.orderBy("i").select(*[v.alias(k) for k, v in ingest.bibliography(F.col("p"), F.col("x")).items()]).collect()
    for r, (*_, want) in zip(got, pages, strict=True):
        assert {k: r[k] for k in want} == want
    banner = "王小明等：电缆 老化的一种评估方法  仪器学报 2021，\n某某大学\n第二段文字"
    assert spark.createDataFrame([(banner,)], "p string").select(ingest.title_and_authors(F.col("p"))["title"]).first()[0] == "电缆老化的一种评估方法"


def test_nested_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1"}, {"sources": [{"source_id": "S2", "title": "t"}, [{"id": "3"}]], "other": [{"id": "no"}]}, 5, None]))
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"core_sources": [{"id": "4", "sources": [{"id": "inner"}]}]}]}))
    (tmp_path / "c.json").write_text("not json")
    got = sorted(json.loads(r["source"]).get("id") or json.loads(r["source"])["source_id"] for r in readers.nested_sources(spark, str(tmp_path)).collect())
    # Lists within an object's list hold no sources; sources hold sources.
    assert got == ["1", "4", "S2", "inner"]


def test_finished_drafts_are_written_even_if_invalid(spark, tmp_path):
    d = drafts(spark, DRAFT.format("S1", "https://x.org/1", ""), "no references [S1]", DRAFT.format("S9", "https://x.org/1", ""))
    got = {r["doc_id"]: r for r in sinks.finished_drafts(d, str(tmp_path / "out")).collect()}
    assert [got[i]["valid"] for i in range(3)] == [True, False, False] and got[2]["problems"] == ["residual [?n]: 1"]


def test_manual_scores_judge_manual_cases_only(spark):
    from attesta.operators import brief

    cases = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False), ("e", True), ("f", False)], "case_id string, manual boolean").selectExpr("*", "'x' AS check", "'1' AS expected")
    results = spark.createDataFrame([("d", "x", "1")], "case_id string, check string, actual string")
    scores = spark.createDataFrame([("a", "pass"), ("b", "weak"), ("d", "weak"), ("e", None), ("f", "pass"), ("z", "pass")], "case_id string, score string")
    got = {r["case_id"]: r["status"] for r in brief.golden(cases, results, scores).collect()}
    assert got == {"a": "passed", "b": "failed", "c": "manual", "d": "passed", "e": "failed", "f": "error"}
