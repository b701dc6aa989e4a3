"""The final gate. Every check of the library feeds one long table of verdicts; a document is released if all checks that it needs passed.

A verdict is a row (doc_id, gate, check, passed, reason). Gates are A, the finished text; B, its numeric citations; C, the working draft, its corpus, framework, style and case; D, what people check, of which
some can be told by rule. Which checks a document needs is data too, by its kind: a check without a verdict fails as absent. Drafts and finished texts are read once each: all verdicts over one text are expressions over its
row, exploded; what concerns a case is aggregated before it is joined.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as t
from attesta.operators import citations, documents

GATES = ("A", "B", "C", "D")
_ROW = "array<struct<gate:string,check:string,passed:boolean,reason:string>>"
#: Checks of every delivery, and those that a kind of document needs besides.
BASIC = (("A", "residuals"), ("A", "placeholders"), ("B", "closure"), ("B", "sequence"), ("C", "closure"), ("C", "minimum"), ("D", "one reference section"), ("D", "unique urls"))
BY_KIND = {"framework": (("C", "framework depth"),), "paper": (("C", "scorecard"),), "case": (("C", "corpus"), ("C", "stages"), ("C", "audit"))}
#: What covers hold in place of numbers, and traces of crawlers and prompts.
COVER_HOLDS = ("编号：2023x", "资助项目", "references/", "标记图例", "附录A 证据缺口清单", "反爬", "NRC ADAMS 不可下载")
COVER = r"编号：2023x+|资助项目|references/[\w-]+\.md|标记图例|附录A 证据缺口清单|反爬|NRC ADAMS 不可下载"


def _verdict(gate: str, check: str, passed: Column, reason: Column | str = "") -> Column:
    said = F.lit(reason) if isinstance(reason, str) else reason
    ok = F.coalesce(passed, F.lit(False))
    return F.struct(F.lit(gate).alias("gate"), F.lit(check).alias("check"), ok.alias("passed"), F.when(ok, "").otherwise(F.coalesce(said, F.lit(""))).alias("reason"))


def _exploded(d: DataFrame, verdicts: list[Column]) -> DataFrame:
    return d.select("doc_id", F.explode(F.array(*verdicts).cast(_ROW)).alias("v")).select("doc_id", "v.*")


def final_verdicts(finals: DataFrame, min_sources: int | None = None) -> DataFrame:
    """A, B and what D can be told by rule, over finished texts (doc_id, final); a null text fails all."""
    return _exploded(*_of_finals(finals, min_sources))


def _of_finals(finals: DataFrame, min_sources: int | None) -> tuple[DataFrame, list[Column]]:
    names = [x for x in finals.columns if x not in ("text", "final")]
    d = citations.numeric_closure(finals.select(*names, F.col("final").alias("text")), min_sources=min_sources)
    d = d.withColumns({
        "left": F.array_join(F.transform(citations.residuals(F.col("text")), lambda x: x["name"]), ","), "sections": F.size(t.lines_where(F.col("text"), citations.REFS_FIRST, "##")),
        "urls": F.transform(t.find_all(F.col("text"), r"(?m)^\[(?:S\d+|\d+)\].*?(https?://\S+?)[\s.]*$"), lambda u: F.rtrim(u, F.lit("."))),
    })
    left, sections = F.col("left"), F.col("sections")
    joined = lambda c: F.array_join(c, ",")
    return d, [
        _verdict("A", "residuals", left == "", left), _verdict("A", "placeholders", ~F.when(reduce(or_, [F.contains("text", F.lit(x)) for x in COVER_HOLDS]), F.col("text").rlike(COVER)).otherwise(F.col("text").isNull())),
        _verdict("B", "closure", (F.size("orphaned") == 0) & (F.size("unused") == 0) & ~F.col("few_sources"), F.concat_ws(";", joined("orphaned"), joined("unused"))), _verdict("B", "sequence", F.size("gaps") == 0, joined("gaps")),
        _verdict("D", "one reference section", sections == 1, sections.cast("string")), _verdict("D", "unique urls", F.size("urls") == F.size(F.array_distinct("urls"))),
    ]


def draft_verdicts(drafts: DataFrame, min_sources: int | None = None, min_chars: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """C over working drafts (doc_id, text): citations closed, as many sources and characters as the kind asks for."""
    return _exploded(*_of_drafts(drafts, min_sources, min_chars, sources))


def _of_drafts(drafts: DataFrame, min_sources: int | None, min_chars: int | None, sources: DataFrame | None = None) -> tuple[DataFrame, list[Column]]:
    d = citations.closure(drafts, min_sources, min_chars, sources)
    lists = ("orphaned", "unused", "orphaned_gaps", "unused_gaps", "missing_urls", "overused", "mismatched")
    open_ = F.concat_ws(";", *[F.when(F.size(x) > 0, F.concat(F.lit(f"{x}="), F.array_join(x, ","))) for x in lists])
    return d, [_verdict("C", "closure", (open_ == "") & F.col("text").isNotNull(), open_), _verdict("C", "minimum", ~F.col("few_sources") & ~F.col("thin"), F.concat_ws(",", F.col("n_refs").cast("string"), F.col("body_chars").cast("string")))]


def delivery_rows(drafts: DataFrame, min_sources: int | None = None, min_chars: int | None = None) -> DataFrame:
    """(doc_id, verdicts): those of working drafts and of their finished texts, in one pass over the drafts (doc_id, text)."""
    d, of_draft = _of_drafts(drafts.select("doc_id", "text"), min_sources, min_chars)
    d, of_final = _of_finals(citations.finished(d.select("doc_id", "text", F.array(*of_draft).cast(_ROW).alias("of_draft"))), min_sources)
    return d.select("doc_id", F.concat("of_draft", F.array(*of_final).cast(_ROW)).alias("verdicts"))


def case_rows(verdicts: DataFrame) -> DataFrame:
    """(doc_id, verdicts) of a long table of verdicts."""
    return verdicts.groupBy("doc_id").agg(F.collect_list(F.struct("gate", "check", "passed", "reason")).cast(_ROW).alias("verdicts"))


def framework_verdicts(docs: DataFrame, min_chars: int = 1200) -> DataFrame:
    """C: framework documents, all of whose chapters are deep enough. A document without chapters fails."""
    by = documents.framework_depth(docs, min_chars).groupBy("doc_id").agg(F.every("passed").alias("ok"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("title")))).alias("thin"))
    return _exploded(docs.select("doc_id").join(by, "doc_id", "left"), [_verdict("C", "framework depth", F.col("ok"), F.coalesce(F.array_join("thin", ","), F.lit("no chapters")))])


def case_verdicts(check: str, rows: DataFrame, passed: Column, reason: Column | None = None, gate: str = "C") -> DataFrame:
    """Verdicts of any other operator's rows (doc_id, ...): a document passes if all of its rows do; reasons are joined."""
    said = F.lit("") if reason is None else reason
    by = rows.groupBy("doc_id").agg(F.every(F.coalesce(passed, F.lit(False))).alias("ok"), F.array_join(F.array_sort(F.collect_set(F.when(~F.coalesce(passed, F.lit(False)), said))), ";").alias("why"))
    return _exploded(by, [_verdict(gate, check, F.col("ok"), F.col("why"))])


def needed(docs: DataFrame, basic: tuple = BASIC, by_kind: dict | None = None) -> DataFrame:
    """(doc_id, gate, check) that each document (doc_id, kinds) needs; a null list is none."""
    return _needed_rows(docs, basic, by_kind).select("doc_id", F.explode("needed").alias("n")).select("doc_id", "n.*")


def _needed_rows(docs: DataFrame, basic: tuple, by_kind: dict | None) -> DataFrame:
    by_kind = BY_KIND if by_kind is None else by_kind
    kind = "array<struct<gate:string,check:string>>"
    rows = lambda checks: F.array(*[F.struct(F.lit(g).alias("gate"), F.lit(c).alias("check")) for g, c in checks]).cast(kind)
    parts = [rows(basic)] + [F.when(F.coalesce(F.array_contains("kinds", name), F.lit(False)), rows(checks)).otherwise(F.array().cast(kind)) for name, checks in by_kind.items()]
    return docs.select("doc_id", F.array_distinct(F.concat(*parts)).alias("needed"))


def released(docs: DataFrame, verdicts: DataFrame, basic: tuple = BASIC, by_kind: dict | None = None) -> DataFrame:
    """(doc_id, a, b, c, d, failing, released): whether each gate and all of them passed, and what failed, as `gate check: reason`.

    Of several verdicts of one check the worst counts. A verdict that a document doesn't need is still held against it if it failed.
    """
    one = verdicts.groupBy("doc_id", "gate", "check").agg(F.every("passed").alias("passed"), F.max(F.when(~F.col("passed"), F.col("reason"))).alias("reason"))
    asked = needed(docs, basic, by_kind).withColumn("asked", F.lit(True))
    d = asked.join(one.join(docs.select("doc_id"), "doc_id", "left_semi"), ["doc_id", "gate", "check"], "full")
    ok = F.coalesce("passed", F.lit(False))
    why = F.when(F.col("passed").isNull(), "absent").otherwise(F.coalesce("reason", F.lit("")))
    line = F.concat_ws(" ", "gate", F.concat("check", F.when(why != "", F.concat(F.lit(": "), why)).otherwise("")))
    gates = [F.coalesce(F.every(F.when(F.col("gate") == g, ok)), F.lit(True)).alias(g.lower()) for g in GATES]
    out = d.withColumn("line", F.when(~ok, line)).groupBy("doc_id").agg(*gates, F.array_sort(F.collect_list("line")).alias("failing"))
    return out.withColumn("released", F.size("failing") == 0)


def released_rows(docs: DataFrame, parts: list[DataFrame], basic: tuple = BASIC, by_kind: dict | None = None) -> DataFrame:
    """`released` where verdicts come as rows (doc_id, verdicts) of documents: one shuffle of a row for each document and part, and expressions over it."""
    asked = _needed_rows(docs, basic, by_kind)
    none = lambda like, of: F.lit(None).cast(like.schema[of].dataType).alias(of)
    d = asked.select("doc_id", "needed", none(parts[0], "verdicts"))
    for x in parts:
        d = d.unionByName(x.select("doc_id", none(asked, "needed"), "verdicts"))
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    d = d.groupBy("doc_id").agg(F.bool_or(F.col("needed").isNotNull()).alias("known"), flat("needed"), flat("verdicts")).where("known")
    d = d.select("doc_id", F.array_distinct("needed").alias("needed"), F.filter("verdicts", lambda v: v["passed"].isNotNull()).alias("verdicts"))
    key = lambda x: F.struct(x["gate"].alias("gate"), x["check"].alias("check"))
    d = d.withColumn("told", F.array_distinct(F.transform("verdicts", key))).withColumn("absent", F.array_except("needed", "told")).withColumn("wrong", F.filter("verdicts", lambda v: ~v["passed"]))
    at = lambda c, g: F.exists(c, lambda x: x["gate"] == g)
    gates = [(~at("absent", g) & ~at("wrong", g)).alias(g.lower()) for g in GATES]
    named = lambda x, why: F.concat_ws(" ", x["gate"], F.concat(x["check"], why))
    reason = lambda x: F.coalesce(F.array_max(F.transform(F.filter("wrong", lambda v: (v["gate"] == x["gate"]) & (v["check"] == x["check"])), lambda v: v["reason"])), F.lit(""))
    said = F.transform(F.array_distinct(F.transform("wrong", key)), lambda x: named(x, F.when(reason(x) != "", F.concat(F.lit(": "), reason(x))).otherwise("")))
    out = d.where(F.size("needed") + F.size("told") > 0).select("doc_id", *gates, F.array_sort(F.concat(said, F.transform("absent", lambda x: named(x, F.lit(": absent"))))).alias("failing"))
    return out.withColumn("released", F.size("failing") == 0)
