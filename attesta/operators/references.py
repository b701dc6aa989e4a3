"""Reference entries in two formats, their section, and where it goes in a draft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as t
from attesta.functions.evidence import filled
from attesta.operators.citations import MAP_HEADING, REFS_FIRST

HEADING = "## 参考文献"


def _f(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit(""))


def _tag() -> Column:
    return F.when(_f("source_id").rlike(r"^S\d+$"), _f("source_id")).otherwise(F.concat(F.lit("S"), _f("source_id")))


def _title() -> Column:
    return filled(F.col("title"), F.col("title_or_name"))


def plain_entry() -> Column:
    """`[Sx] title. publisher, year. URL: u`; what is missing leaves no marks."""
    publisher, year, url = _f("publisher"), _f("year"), _f("url")
    middle = F.when(publisher != "", F.concat(F.lit(" "), publisher, F.when(year != "", F.concat(F.lit(", "), year)).otherwise(""), F.lit("."))).when(year != "", F.concat(F.lit(" "), year, F.lit("."))).otherwise("")
    return F.concat(F.lit("["), _tag(), F.lit("] "), _title(), F.lit("."), middle, F.when(url != "", F.concat(F.lit(" URL: "), url)).otherwise(" (URL unavailable)"))


def bilingual_line() -> Column:
    """The English line of an entry; empty without an English title."""
    year, volume, issue, page = _f("year"), _f("volume"), _f("issue"), _f("page")
    number = F.when(volume != "", F.concat(F.lit(", "), volume, F.lit("("), F.when(issue != "", issue).otherwise("?"), F.lit(")"), F.when(page != "", F.concat(F.lit(": "), page)).otherwise(""))).otherwise("")
    series = F.when(_f("series_en") != "", _f("series_en")).when((_f("journal_en") != "") & (year != ""), F.concat(_f("journal_en"), F.lit(", "), year, number)).otherwise(year)
    head = F.when(_f("authors_en") != "", F.concat(_f("authors_en"), F.lit(". "))).otherwise("")
    return F.when(_f("title_en") != "", F.concat(head, _f("title_en"), F.lit("[J]."), F.when(series != "", F.concat(F.lit(" "), series, F.lit("."))).otherwise(""))).otherwise("")


def typed_entry() -> Column:
    """By the type of the source: journal paper [J], standard [S], web page [EB/OL], else report [R]."""
    title, publisher, year, url, series, authors, city = _title(), _f("publisher"), _f("year"), _f("url"), _f("series"), _f("authors"), _f("city")
    journal = F.concat(F.when(authors != "", F.concat(authors, F.lit(". "))).otherwise(""), title, F.lit("[J]. "), series, F.lit("."))
    journal = F.trim(F.regexp_replace(F.regexp_replace(journal, r"\.\s*\.$", "."), r"\s{2,}", " "))
    journal = F.concat(journal, F.when(bilingual_line() != "", F.concat(F.lit("\n    "), bilingual_line())).otherwise(""))
    standard = F.concat(F.when(series != "", F.concat(series, F.lit(". "))).otherwise(""), title, F.lit("[S]."))
    head = F.when(publisher != "", F.concat(publisher, F.lit(". "))).otherwise("")
    link = F.when(url != "", F.concat(F.lit(" "), url, F.lit("."))).otherwise("")
    web = F.concat(head, title, F.lit("[EB/OL]."), F.when(year != "", F.concat(F.lit(" "), year, F.lit("[引用日期见正文]."))).otherwise(""), link)
    place = F.when((city != "") & (publisher != ""), F.concat(city, F.lit(": "))).otherwise("")
    tail = F.when(publisher != "", F.concat(place, publisher, F.when(year != "", F.concat(F.lit(", "), year)).otherwise(""), F.lit("."))).when(year != "", F.concat(year, F.lit("."))).otherwise("")
    report = F.concat(head, title, F.lit("[R]. "), F.when(series != "", F.concat(series, F.lit(". "))).otherwise(""), tail, link)
    kind = _f("type")
    return F.when(kind == "journal_paper", journal).when(kind.isin("china_standard", "international_standard", "safety_standard"), standard).when(kind.isin("epri_web", "industry_article"), web).otherwise(report)


def section(sources: DataFrame, typed: bool = False) -> DataFrame:
    """P25: (case_id, section) of sources with case_id and pos; the typed one numbers its entries and ends with a map of tags to numbers."""
    row = F.struct("pos", (typed_entry() if typed else plain_entry()).alias("e"), _tag().alias("t"))
    d = sources.groupBy("case_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    if not typed:
        return d.select("case_id", F.concat(F.lit(HEADING + "\n\n"), F.array_join(F.transform("rows", lambda r: r["e"]), "\n\n"), F.lit("\n")).alias("section"))
    n = lambda i: (i + 1).cast("string")
    lines = F.transform("rows", lambda r, i: F.concat(F.lit("["), n(i), F.lit("] "), r["e"], F.lit("\n\n")))
    table = F.transform("rows", lambda r, i: F.concat(F.lit("| ["), r["t"], F.lit("] | ["), n(i), F.lit("] |\n")))
    title = MAP_HEADING + "（投稿核查用，投稿版删除本节）\n\n| [Sx] | [n] |\n|-----|-----|\n"
    return d.select("case_id", F.concat(F.lit(HEADING + "\n\n"), F.array_join(lines, ""), F.lit("\n" + title), F.array_join(table, "")).alias("section"))


def spliced(text: Column, new: Column) -> Column:
    """SK7: the draft with its reference section replaced, its own heading kept; without one, the section goes before the first appendix or to the end."""
    lines, n = F.split(text, "\n", -1), F.size(F.split(text, "\n", -1))
    start = F.array_min(t.lines_where(text, REFS_FIRST))
    heads = F.filter(F.transform(lines, lambda x, i: F.when(x.startswith("## "), i)), lambda i: i.isNotNull())
    stop = F.coalesce(F.array_min(F.filter(heads, lambda i: i > start)), n)
    body = F.rtrim(F.regexp_replace(new, r"^[^\n]*\n", ""), F.lit("\n"))
    after = F.when(stop < n, t.line_range(text, stop, n)).otherwise("")
    before = lambda to: F.when(to > 0, F.concat(t.line_range(text, F.lit(0), to), F.lit("\n"))).otherwise("")
    replaced = F.concat(before(start), F.get(lines, start), F.lit("\n"), body, F.lit("\n"), after)
    app = F.array_min(t.lines_where(text, "^## 附录"))
    inserted = F.concat(before(app), new, F.lit("\n"), t.line_range(text, app, n))
    appended = F.concat(F.rtrim(text, F.lit("\n")), F.lit("\n\n"), new)
    return F.when(start.isNotNull(), replaced).when(app.isNotNull(), inserted).otherwise(appended)
