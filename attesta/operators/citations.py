"""Drafts and their citations: boundaries, markers, closure, numbering and the finished text.

A draft is one row; everything about one draft is an expression over its row, so that any number of
drafts is checked without a shuffle. Comparisons across drafts explode markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as t
from attesta.operators.ingest import mismatched_ids

_HEADING = r"^##\s*(?:\d+[.、]\s*)?"
#: Closure takes the last heading that is alone on its line, the finisher the first, whatever follows it.
REFS_LAST = _HEADING + r"(参考文献|References|Bibliography|文献)\s*$"
REFS_FIRST = _HEADING + r"(参考文献|References|Bibliography|文献)(?U)(?!\w)"
APPENDIX_LAST = _HEADING + r"(附录A|附录 A|Appendix A|Appendix)(?=$|[\s:：])"
APPENDIX_FIRST = r"^##\s*(?:附录\s*A|附录\s*Ａ|Appendix\s*A)(?U)(?!\w)"
#: Tags that a finished text doesn't have.
PLACEHOLDERS = ("[假设]", "[待内部确认]", "[待验证]", "[待核验]")
#: What is left over from drafting, as (pattern, name, what every match holds).
RESIDUALS = (
    (r"\[S\d+\]", "[Sx]", "[S"), (r"\[G\d+\]", "[Gx]", "[G"), (r"\[假设\]", "[假设]", "[假设]"), (r"\[待内部确认\]", "[待内部确认]", "[待内部确认]"), (r"\[待验证\]", "[待验证]", "[待验证]"),
    *[(x, x, x) for x in ("待核验", "thesis_format", "标记图例", "证据缺口", "附录A", "NRC ADAMS", "反爬", "待填写")], (r"\?\d+\]", "[?n]", "?"),
)
MAP_HEADING = "### [Sx]↔[n] 对照表"
ENTRY_START = r"\n(?=\[(?:S\d+|\d+)\])"


def refs_boundary_last(text: Column) -> tuple[Column, Column, Column]:
    """Body, references and appendix. A heading in the first line counts as none."""
    n = F.size(F.split(text, "\n", -1))
    last = lambda p: F.nullif(F.coalesce(F.array_max(t.lines_where(text, p, "##")), F.lit(0)), F.lit(0))
    refs, app = last(REFS_LAST), last(APPENDIX_LAST)
    body_end, ref_end = F.coalesce(refs, app, n), F.coalesce(app, n)
    empty = F.lit("")
    return t.line_range(text, F.lit(0), body_end), F.when(refs.isNotNull(), t.line_range(text, body_end, ref_end)).otherwise(empty), F.when(app.isNotNull(), t.line_range(text, ref_end, n)).otherwise(empty)


def split_drafts(drafts: DataFrame) -> DataFrame:
    """`drafts` with body, refs and appendix. A heading in the first line counts as none. The text is split once and each boundary sought once, as columns of their own."""
    d = drafts.withColumn("_lines", F.split("text", "\n", -1))
    last = lambda p: F.array_max(t.places_where(F.col("_lines"), p, "##"))
    d = d.withColumns({"_refs_at": last(REFS_LAST), "_app_at": last(APPENDIX_LAST)})
    d = d.withColumns({x: F.when(F.col(x) > 0, F.col(x)) for x in ("_refs_at", "_app_at")})
    lines, refs, app, n, empty = F.col("_lines"), F.col("_refs_at"), F.col("_app_at"), F.size("_lines"), F.lit("")
    body_end, ref_end = F.coalesce(refs, app, n), F.coalesce(app, n)
    return d.withColumns({
        "body": t.joined_range(lines, F.lit(0), body_end), "refs": F.when(refs.isNotNull(), t.joined_range(lines, body_end, ref_end)).otherwise(empty),
        "appendix": F.when(app.isNotNull(), t.joined_range(lines, ref_end, n)).otherwise(empty),
    }).drop("_lines", "_refs_at", "_app_at")


def markers(column: str, pattern: str) -> Column:
    """The different markers, in order of their text."""
    return F.array_sort(F.array_distinct(t.find_all(F.col(column), pattern)))


def entries_without_url(refs: Column) -> Column:
    """tags of reference entries that hold no URL."""
    entries = F.split(refs, ENTRY_START, -1)
    tags = F.transform(F.filter(entries, lambda e: e.rlike(r"\[(S\d+|\d+)\]") & ~e.rlike("(?:https?|file)://")), lambda e: F.regexp_extract(e, r"\[(S\d+|\d+)\]", 1))
    return F.array_sort(F.array_distinct(tags))


def closure(drafts: DataFrame, min_sources: int | None = None, min_chars: int | None = None, sources: DataFrame | None = None, threshold: int = 5) -> DataFrame:
    """G1: what is cited without reference, referenced without citation, and what is too little.

    With `sources` (source_id, title, source_level) also sources of level C cited more often than `threshold`, and entries whose
    title isn't the corpus's. Without them a draft is checked within its row.
    """
    d = split_drafts(drafts).withColumns({"cited": markers("body", t.SOURCE_MARK), "listed": markers("refs", t.SOURCE_MARK), "gaps": markers("body", t.GAP_MARK)})
    d = d.withColumn("listed_gaps", F.array_sort(F.array_union(markers("appendix", t.GAP_MARK), markers("appendix", t.BARE_GAP_MARK))))
    d = d.withColumns({
        "orphaned": F.array_except("cited", "listed"), "unused": F.array_except("listed", "cited"),
        "orphaned_gaps": F.array_except("gaps", "listed_gaps"), "unused_gaps": F.array_except("listed_gaps", "gaps"),
        "missing_urls": entries_without_url(F.col("refs")), "n_refs": F.size("listed"), "body_chars": t.dense_length(F.col("body")),
    })
    few = F.lit(False) if min_sources is None else F.col("n_refs") < min_sources
    thin = F.lit(False) if min_chars is None else F.col("body_chars") < min_chars
    none = F.array().cast("array<string>")
    if sources is None:
        d = d.withColumns({"overused": none, "mismatched": none})
    else:
        often = overused(drafts, source_levels(sources), threshold).groupBy("doc_id").agg(F.sort_array(F.collect_list("ref")).alias("overused"))
        unlike = mismatched_ids(title_entries(d), sources).groupBy("doc_id").agg(F.sort_array(F.collect_list("source_id")).alias("mismatched"))
        d = d.join(often, "doc_id", "left").join(unlike, "doc_id", "left").withColumns({x: F.coalesce(x, none) for x in ("overused", "mismatched")})
    clean = F.lit(True)
    for c in ("orphaned", "unused", "orphaned_gaps", "unused_gaps", "missing_urls", "overused", "mismatched"):
        clean = clean & (F.size(c) == 0)
    return d.withColumns({"few_sources": few, "thin": thin, "passed": clean & ~few & ~thin})


def reference_entries(split: DataFrame) -> DataFrame:
    """(doc_id, source_id, entry) of the reference lists of split drafts: an entry begins at a line that begins with its tag."""
    entries = F.filter(F.split(F.concat(F.lit("\n"), "refs"), ENTRY_START, -1), lambda e: e.rlike(r"^\[S\d+\]"))
    d = split.select("doc_id", F.explode(entries).alias("entry"))
    return d.select("doc_id", F.regexp_extract("entry", r"^\[(S\d+)\]", 1).alias("source_id"), "entry")


def title_entries(split: DataFrame) -> DataFrame:
    """P8 for the title check: (doc_id, source_id, entry) of what stands between a blank line and a bracket; a block without a blank line before it belongs to the one before."""
    blocks = F.transform(F.split("refs", r"\n\n(?=\[)", -1), lambda e: F.btrim(e, F.lit(" \t\r\n\x0b\x0c")))
    d = split.select("doc_id", F.explode(F.filter(blocks, lambda e: e.rlike(r"^\[S\d+\]"))).alias("entry"))
    return d.select("doc_id", F.regexp_extract("entry", r"^\[(S\d+)\]", 1).alias("source_id"), "entry")


def source_levels(sources: DataFrame) -> DataFrame:
    """(ref, level) of sources of level B or C, by the number in their id."""
    d = sources.select(F.regexp_extract("source_id", r"^S(\d+)", 1).alias("ref"), F.upper("source_level").alias("level"))
    return d.where((F.col("ref") != "") & F.col("level").isin("B", "C")).groupBy("ref").agg(F.max("level").alias("level"))


def numeric_closure(drafts: DataFrame, min_sources: int | None = None, min_chars: int | None = None) -> DataFrame:
    """The same for numbers, with the same minima; a reference is a line that begins with its number. Gaps are numbers up to the largest that no reference has."""
    d = split_drafts(drafts)
    numbers = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda v: v.cast("int"))))
    d = d.withColumns({"cited": numbers(t.find_all(F.col("body"), t.NUMBER_MARK)), "listed": numbers(t.find_all(F.col("refs"), r"(?m)^\[(\d+)\]"))})
    gaps = F.when(F.size("listed") > 0, F.array_except(F.sequence(F.lit(1), F.array_max("listed")), "listed")).otherwise(F.array().cast("array<int>"))
    d = d.withColumns({"orphaned": F.array_except("cited", "listed"), "unused": F.array_except("listed", "cited"), "gaps": gaps})
    d = d.withColumns({"n_refs": F.size("listed"), "body_chars": t.dense_length(F.col("body"))})
    few = F.lit(False) if min_sources is None else F.col("n_refs") < min_sources
    thin = F.lit(False) if min_chars is None else F.col("body_chars") < min_chars
    return d.withColumns({"few_sources": few, "thin": thin}).withColumn("passed", (F.size("orphaned") == 0) & (F.size("unused") == 0) & (F.size("gaps") == 0) & ~F.col("few_sources") & ~F.col("thin"))


def exploded(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations of the body (doc_id, ref, pos) and of the reference list, one row each, repeats included."""
    d = split_drafts(drafts)
    rows = lambda c: d.select("doc_id", F.posexplode(t.find_all(F.col(c), t.SOURCE_MARK)).alias("pos", "ref"))
    return rows("body"), rows("refs")


def orphaned(drafts: DataFrame) -> DataFrame:
    """Cited, not listed."""
    body, refs = exploded(drafts)
    return body.select("doc_id", "ref").distinct().join(refs, ["doc_id", "ref"], "left_anti")


def unused(drafts: DataFrame) -> DataFrame:
    body, refs = exploded(drafts)
    return refs.select("doc_id", "ref").distinct().join(body, ["doc_id", "ref"], "left_anti")


def citation_counts(drafts: DataFrame) -> DataFrame:
    """A1: how often a draft cites each source, and where first."""
    return exploded(drafts)[0].groupBy("doc_id", "ref").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def most_cited(drafts: DataFrame, k: int = 5, levels: DataFrame | None = None) -> DataFrame:
    """Of each draft, with levels (ref, level) where they are given, else A; ties keep their order of appearance."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    top = citation_counts(drafts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.withColumn("level", F.lit("A")) if levels is None else top.join(levels, "ref", "left").withColumn("level", F.coalesce("level", F.lit("A")))


def overused(drafts: DataFrame, levels: DataFrame, threshold: int = 5) -> DataFrame:
    """Sources of level C that a draft cites more often than `threshold`. Citations of others are left out before they are counted."""
    body = exploded(drafts)[0].join(levels.where(F.col("level") == "C").select("ref"), "ref", "left_semi")
    return body.groupBy("ref", "doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where(F.col("n") > threshold)


def marker_totals(text: Column) -> dict[str, Column]:
    """Markers of sources and gaps, those of review rounds, and lines."""
    marks = {"s": t.SOURCE_MARK, "g": t.GAP_MARK, "round_s": t.ROUND_SOURCE_MARK, "round_g": t.ROUND_GAP_MARK}
    return {n: t.count(text, p) for n, p in marks.items()} | {"lines": F.size(F.split(text, "\n", -1))}


def number_map(refs: Column) -> Column:
    """Keys of the reference list in order of first occurrence; a key's place is its number."""
    return F.array_distinct(t.find_all(refs, r"(?m)^\[S?(\d+)\]"))


def renumbered(text: Column, keys: Column, mark: str = r"\[S(\d+)\]") -> Column:
    """Every [Sx] as the number of its key, or [?x]. The text is split at the marks once, whatever their number."""
    parts = F.arrays_zip(F.split(text, mark, -1).alias("text"), t.find_all(text, mark).alias("key"))
    number = lambda key: F.coalesce(F.nullif(F.array_position(keys, key), F.lit(0)).cast("string"), F.concat(F.lit("?"), key))
    return F.array_join(F.transform(parts, lambda x: F.concat(x["text"], F.coalesce(F.concat(F.lit("["), number(x["key"]), F.lit("]")), F.lit("")))), "")


def _cleaned(text: Column) -> Column:
    """Without tags, legend, comments, cover placeholders and traces of the search."""
    out = text
    for tag in PLACEHOLDERS:
        out = F.replace(out, F.lit(tag), F.lit(""))
    out = t.replaced(out, r"编号：\S*\[?待内部确认\]?", "编号：XXXXXXXX（作者学号）", "待内部确认")
    out = t.replaced(out, r"编号：2023\d*", "编号：XXXXXXXX（作者学号）", "编号：2023")
    for old in ("资助项目：[待内部确认]", "　资助项目：", "资助项目："):
        out = F.replace(out, F.lit(old), F.lit(""))
    return t.replaced(out, r"(?s)<!--.*?-->", "", "<!--")


def _academic(text: Column) -> Column:
    """Phrases for what could not be fetched."""
    out = t.replaced(text, r"NRC ADAMS\s*PDF\s*受反爬限制不可下载", "部分NRC历史档案全文无法在线获取", "NRC ADAMS")
    return F.replace(F.replace(out, F.lit("受反爬限制不可下载"), F.lit("全文无法在线获取")), F.lit("PDF受反爬限制"), F.lit("全文受访问限制"))


LIMITATIONS = "## 研究局限\n\n本文基于已审计公开来源展开，以下方面因证据可得性与范围限制未予充分展开，有待后续工作补充：\n\n"


def finished(drafts: DataFrame) -> DataFrame:
    """`drafts` with final, the text to hand in; null without a reference section.

    The appendix of gaps goes if it stands after the references; gaps that the body cites become limitations.
    """
    d = drafts.withColumn("_lines", F.split("text", "\n", -1))
    lines, n = F.col("_lines"), F.size("_lines")
    d = d.withColumns({"_ref": F.array_min(t.places_where(lines, REFS_FIRST, "##")), "_app": F.array_min(t.places_where(lines, APPENDIX_FIRST, "##"))})
    cut = F.col("_app").isNotNull() & (F.col("_app") >= F.col("_ref"))
    d = d.withColumns({"_block": F.when(cut, t.joined_range(lines, F.col("_app"), n)).otherwise(""), "_all": F.when(cut, F.concat(F.rtrim(t.joined_range(lines, F.lit(0), F.col("_app")), F.lit(" \n\t\r")), F.lit("\n"))).otherwise(F.col("text"))})
    d = d.withColumn("_lines", F.split("_all", "\n", -1))
    d = d.withColumns({"_body": t.joined_range(lines, F.lit(0), F.col("_ref")), "_refs": t.joined_range(lines, F.col("_ref"), n)})
    d = d.withColumn("_keys", number_map(F.col("_refs")))
    d = d.withColumns({"_body": renumbered(F.col("_body"), F.col("_keys")), "_refs": renumbered(F.col("_refs"), F.col("_keys"), r"(?m)^\[S(\d+)\]")})
    d = d.withColumn("_gaps", F.array_distinct(F.transform(t.find_all(F.col("_body"), t.GAP_MARK), lambda g: g.cast("int"))))
    body = t.replaced(t.replaced(F.col("_body"), r"\[G\d+\]", "", "[G"), r"(?m)^> \*\*标记图例\*\*.*$", "", "标记图例")
    body = _academic(F.replace(_cleaned(body), F.lit("相关论断均以公开摘要级结论支撑，具体详见附录A。"), F.lit("")))
    body = F.rtrim(t.replaced(body, r"\n{3,}", "\n\n", "\n\n\n"), F.lit(" \n\t\r"))
    row = r"(?m)^\|\s*\[?G?(\d+)\]?\s*\|(.+?)\|\s*$"
    rows = F.arrays_zip(t.find_all(F.col("_block"), row, 1).alias("g"), t.find_all(F.col("_block"), row, 2).alias("d"))
    named = F.filter(rows, lambda x: F.array_contains("_gaps", x["g"].cast("int")))
    lines = F.transform(named, lambda x: _academic(F.concat(x["g"].cast("int").cast("string"), F.lit(". "), F.coalesce(F.get(F.filter(F.transform(F.split(x["d"], r"\|"), lambda y: F.trim(y)), lambda y: y != ""), F.lit(0)), F.trim(x["d"])))))
    d = d.withColumns({"_body": body, "_rows": lines})
    limits = F.when(F.size("_rows") > 0, F.concat(F.lit("\n\n" + LIMITATIONS), F.array_join("_rows", "\n"))).otherwise("")
    final = F.concat("_body", limits, F.lit("\n\n"), F.trim(_cleaned(F.col("_refs")), F.lit(" \n\t\r")), F.lit("\n"))
    return d.withColumn("final", final).drop(*[c for c in d.columns if c.startswith("_")])


def residuals(text: Column) -> Column:
    """(name, n) of what is left of drafting outside the map table. A pattern is tried on texts that hold its fixed part."""
    at = F.instr(text, MAP_HEADING)
    n = lambda scan, p, part: F.when(F.contains(scan, F.lit(part)), t.count(scan, p)).otherwise(0)
    found = lambda scan: F.array(*[F.struct(F.lit(name).alias("name"), n(scan, p, part).alias("n")) for p, name, part in RESIDUALS])
    return F.filter(t.let(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), found), lambda x: x["n"] > 0)


def final_problems(drafts: DataFrame) -> DataFrame:
    """(doc_id, problem) of finished texts (doc_id, final)."""
    start = F.array_min(t.lines_where(F.col("final"), REFS_FIRST, "##"))
    d = drafts.withColumn("_ref", start).withColumn("_refs", F.when(F.col("_ref").isNotNull(), t.line_range(F.col("final"), F.col("_ref"), F.size(F.split("final", "\n", -1)))))
    d = d.withColumns({"_numbers": F.transform(t.find_all(F.col("_refs"), r"(?m)^\[(\d+)\]"), lambda x: x.cast("int")), "_urls": t.find_all(F.col("_refs"), r"(https?://[^\s\]]+)")})
    count = F.size("_numbers")
    broken = (count > 0) & (F.col("_numbers") != F.sequence(F.lit(1), F.greatest(count, F.lit(1))))
    again = F.transform(F.filter(F.transform("_urls", lambda u, i: F.when(F.array_position("_urls", u) <= i, u)), lambda u: u.isNotNull()), lambda u: F.concat(F.lit("duplicate URL: "), u))
    none = F.array().cast("array<string>")
    left = F.transform(residuals(F.col("final")), lambda x: F.concat(F.lit("residual "), x["name"], F.lit(": "), x["n"].cast("string")))
    rest = F.when(F.col("_ref").isNull(), F.array(F.lit("no reference section"))).otherwise(F.concat(F.when(broken, F.array(F.lit("numbering"))).otherwise(none), F.coalesce(again, none)))
    return d.select("doc_id", F.explode(F.concat(left, rest)).alias("problem"))


def changes(drafts: DataFrame) -> DataFrame:
    """What finishing changes, in counts."""
    n = lambda c, p: t.count(F.col(c), p)
    tags = sum((F.coalesce(n("text", p) - n("final", p), F.lit(0)) for p in (r"\[假设\]", r"\[待内部确认\]", r"\[待验证\]")), n("text", r"\[待核验\]") - n("final", r"\[待核验\]"))
    return finished(drafts).select("doc_id", n("text", r"\[S\d+\]").alias("marks"), tags.alias("tags"), n("text", r"\[G\d+\]").alias("gaps_before"), n("final", r"\[G\d+\]").alias("gaps_after"))


def invariant(before: DataFrame, after: DataFrame) -> DataFrame:
    """Drafts (doc_id, text) whose markers or numbers an edit changed, as multisets."""
    marks = lambda d: d.select("doc_id", F.array_sort(t.find_all(F.col("text"), r"(\[[SG]?\d+\]|\d+(?:\.\d+)?)")).alias("m"))
    return marks(before).join(marks(after).withColumnRenamed("m", "n"), "doc_id").where(F.col("m") != F.col("n")).select("doc_id")
