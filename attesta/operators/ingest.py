"""What comes in from outside: files by content, bibliographic fields, quotes, diagrams, titles against the corpus."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import text as t
from attesta.functions.evidence import filled
from attesta.operators.corpus import next_ids


def new_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (path, md5) whose content no earlier file has and `seen` (md5) doesn't either; the first path stays."""
    firsts = files.withColumn("_n", F.row_number().over(Window.partitionBy("md5").orderBy("path"))).where("_n = 1").drop("_n")
    return firsts.join(seen.select("md5"), "md5", "left_anti")


# What the lines of a first page tell. Lines with these words are no titles; lines with these are of institutions.
NO_TITLE = (
    r"(?i)摘要|关键词|中图分类|DOI|Vol\.|No\.|第.{1,4}卷|收稿|基金|作者简介|文章编号|abstract|keywords|\d{4}\s*年\s*第|\d{4}\s*年\s*\d{1,2}\s*月|总第|标准与检测|前沿视点|研究方向|Frontier|FRONTIER"
    r"|等[：:]|［\d+］|\[\d+\]|IEEE\s*Std|提出"
)
INSTITUTION = r"公司|大学|研究院|研究所|学院|邮编|\d{6}$"
NAME = r"[\x{4e00}-\x{9fff}·]{2,4}"
ARTICLE_NUMBER = r"文章编号[:：]?\s*(\d{4})-?(\d{4})\((\d{2,4})\)-(\d{4,5})-(\d{1,3})"
CN_JOURNAL = r"([\x{4e00}-\x{9fff}]{2,10})[ \t]*(\d{4})[，,][ \t]*(\d{1,3})[ \t]*\((\d{1,2})\)"
EN_JOURNAL = r"([A-Z][A-Za-z &]{5,60}?)\s*Vol\.?\s*(\d{1,3})\s*No\.?\s*(\d{1,3})"
VOLUME_ISSUE = r"第\s*(\d{1,3})\s*卷\s*第\s*(\d{1,3})\s*期"
DOI = r"DOI[:：]?\s*(10\.\d{4,5}/[^\s，。；]+)"
BANNER = r"^.{1,10}等[：:]\s*(.+?)[\s]+[\x{4e00}-\x{9fff}]{2,10}\s*\d{4}[，,]"
MONTH_YEAR = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{4})"
#: Lines of a first page that may hold the title, characters of a title that comes once and of any, lines and characters of an English one.
#: Lines that patterns are sought in, characters and lines that may hold the journal.
HEAD, JOURNAL_CHARS, JOURNAL_LINES = 40, 600, 12
HEAD_LINES, ALONE, LONGEST, ENGLISH_LINES, ENGLISH_CHARS = 44, 40, 90, 25, 120


def title_candidate(line: Column) -> Column:
    """whether a line may be (a part of) a Chinese title."""
    sentence = line.rlike("[。；]") | (F.regexp_count(line, F.lit("[，,]")) >= 2) | line.rlike(r"^[（(]")
    return ~sentence & ~line.rlike(NO_TITLE) & ~line.rlike(INSTITUTION) & F.length(line).between(6, 60) & line.rlike(t.CJK)


def author_line(line: Column) -> Column:
    """whether a line lists authors: names between commas, or between blanks with numbers of institutions."""
    bare = F.regexp_replace(line, r"[\s\d*＊]+", "")
    spaced = ~line.rlike("[，,、]") & line.rlike(rf"^{NAME}(?:\d{{0,2}}[ \x{{3000}}]+{NAME}){{1,11}}\d{{0,3}}$")
    return bare.rlike(rf"^{NAME}(?:[，,、]{NAME}){{1,11}}$") | spaced


def _blocks(lines: Column, fits: Callable[[Column, Column], Column], between: str) -> Column:
    """Runs of neighbouring lines that fit, joined."""
    marked = F.transform(lines, lambda x, i: F.when(fits(x, i), F.concat(x, F.lit(between))).otherwise("\x01"))
    return F.filter(F.transform(F.split(F.array_join(marked, ""), "\x01+"), lambda x: F.trim(x)), lambda x: x != "")


def best_title(blocks: Column, text: Column) -> Column:
    """T5: of the blocks the one that the text repeats, then the longest; alone, only a short one. Null if none will do."""
    dense = F.regexp_replace(text, r"[\s\x{3000}]", "")

    def scored(block: Column) -> Column:
        begin = F.substring(F.regexp_replace(block, r"[\s\x{3000}]", ""), 1, 12)
        times = (F.length(dense) - F.length(F.replace(dense, begin, F.lit("")))) / F.length(begin)
        return F.struct((times >= 2).alias("repeated"), F.length(block).alias("n"), block.alias("block"))

    best = F.array_max(F.transform(F.filter(blocks, lambda x: F.length(x).between(6, LONGEST)), scored))
    return F.when(best["repeated"] | (best["n"] <= ALONE), best["block"])


def title_and_authors(text: Column) -> Column:
    """struct<title, authors> of a first page: blocks of title lines and the line of authors below one, else the first capitalised lines."""
    norm = t.to_half_width(text)
    lines = F.slice(F.filter(F.transform(F.split(norm, r"\n|\r"), lambda x: F.trim(x)), lambda x: x != ""), 1, HEAD_LINES)

    def read(ls: Column) -> Column:
        above = lambda i: F.coalesce(title_candidate(F.get(ls, i - 1)), F.lit(False))
        chinese = _blocks(ls, lambda x, i: ~author_line(x) & (title_candidate(x) | (x.rlike(r"^[A-Za-z0-9\-()/]{1,12}$") & above(i))), "")
        english = _blocks(F.slice(ls, 1, ENGLISH_LINES), lambda x, i: x.rlike(r"^[A-Z][A-Za-z0-9,\-() ]{3,80}$") & ~x.rlike(NO_TITLE), " ")
        authors = F.get(F.filter(ls, lambda x, i: author_line(x) & above(i)), F.lit(0))
        names = F.array_join(F.filter(F.split(F.regexp_replace(authors, r"[\d*＊]+", " "), r"[，,、\s]+"), lambda x: x != ""), "，")
        # A running head that names the authors holds the title too.
        banner = F.trim(F.regexp_replace(F.regexp_extract(F.array_join(F.slice(ls, 1, HEAD), "\n"), BANNER, 1), r"\s{2,}", " "))
        title = F.regexp_replace(best_title(F.concat(F.filter(F.array(banner), lambda x: x != ""), chinese), norm), r"(?<=[\x{4e00}-\x{9fff}])[ \x{3000}]+(?=[\x{4e00}-\x{9fff}])", "")
        return F.struct(F.coalesce(title, F.substring(F.get(english, F.lit(0)), 1, ENGLISH_CHARS), F.lit("")).alias("title"), F.when(title.isNotNull(), F.coalesce(names, F.lit(""))).otherwise("").alias("authors"))

    return F.transform(F.array(lines), read)[0]


def head_lines(text: Column) -> Column:
    """The lines of a first page that aren't blank, with ASCII letters, digits and signs."""
    return F.filter(F.transform(F.split(t.to_half_width(text), r"\n|\r"), lambda x: F.trim(x)), lambda x: x != "")


def bibliography(text: Column, title: Column | None = None) -> dict[str, Column]:
    """What patterns find in the head of a first page: DOI, journal, volume, issue, pages, year, language; blank if nothing.

    Only the first lines count, of them the journal's header only at the beginning: what is cited further down says nothing of the paper. A DOI has its name before it. A journal that the title holds is none.
    """
    title = F.lit("") if title is None else F.coalesce(title, F.lit(""))
    lines = head_lines(text)

    def read(d: Column) -> Column:
        head, top = d["head"], F.substring(d["head"], 1, JOURNAL_CHARS)
        found = lambda p, i: F.regexp_extract(head, p, i)
        first = lambda *xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs], F.lit(""))
        number = lambda i: found(ARTICLE_NUMBER, i).try_cast("int")
        chinese = lambda i: F.when(~F.contains(title, F.regexp_extract(top, CN_JOURNAL, 1)), F.regexp_extract(top, CN_JOURNAL, i)).otherwise("")
        has_cn, numbered, english = chinese(1) != "", found(VOLUME_ISSUE, 1) != "", found(EN_JOURNAL, 1) != ""
        # Beside a volume and an issue the journal is a short line near the top.
        short = F.transform(F.slice(lines, 1, JOURNAL_LINES), lambda x: F.btrim(x, F.lit("　 □？?■")))
        named = F.regexp_replace(F.get(F.filter(short, lambda x: F.length(x).between(2, 12) & x.rlike(t.CJK) & ~x.rlike(NO_TITLE) & ~x.rlike(r"[\d，,、]") & ~F.contains(title, x)), F.lit(0)), " ", "")
        named = F.when(numbered, F.coalesce(named, F.lit(""))).otherwise("")
        plain_en = F.rtrim(F.ltrim(F.trim(F.regexp_replace(found(EN_JOURNAL, 1), r"\s+", " ")), F.lit(",")), F.lit(","))
        use_en = ~has_cn & (named == "") & english
        pick = lambda i, issue: F.when(has_cn, chinese(i)).when(use_en, found(EN_JOURNAL, issue)).when(numbered, found(VOLUME_ISSUE, issue - 1)).otherwise("")
        issue = first(pick(4, 3), number(3).cast("string"))
        year = first(number(2).cast("string"), F.when(has_cn, chinese(2)), found(MONTH_YEAR, 1), found(r"(20\d{2})\s*年", 1), found(r"[，,]\s*(20\d{2})[，,]", 1))
        journal = F.when(has_cn, F.trim(chinese(1))).when(use_en, plain_en).otherwise(named)
        begin, length = number(4), number(5)
        return F.struct(
            F.rtrim(found(DOI, 1), F.lit(".,;")).alias("doi"), journal.alias("journal"), pick(3, 2).alias("volume"), issue.alias("issue"),
            F.when(begin.isNotNull(), F.concat(begin.cast("string"), F.lit("-"), (begin + length - 1).cast("string"))).otherwise("").alias("page"), year.alias("year"),
            F.when(title.rlike(t.CJK) | journal.rlike(t.CJK), "zh").otherwise("en").alias("lang"),
        )

    got = F.transform(F.array(F.struct(F.array_join(F.slice(lines, 1, HEAD), "\n").alias("head"))), read)[0]
    return {x: got[x] for x in ("doi", "journal", "volume", "issue", "page", "year", "lang")}


def corpus_rows(files: DataFrame, seen: DataFrame, corpus: DataFrame, origin: str = "user") -> DataFrame:
    """SC17: rows of the corpus for files (path, md5, text) whose content is new, under ids that `corpus` (source_id) lacks, by path.

    The year falls back to the one that a file's name begins with; what no pattern finds stays blank.
    """
    new = next_ids(new_files(files, seen).withColumn("pos", F.col("path")), corpus.select("source_id"))
    stem, text = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1), F.coalesce("text", F.lit(""))
    d = new.withColumns({"stem": stem, "head": title_and_authors(text)})
    d = d.withColumns(bibliography(text, F.col("head.title")))
    d = d.withColumns({"title": F.col("head.title"), "authors": F.col("head.authors"), "year": F.coalesce(F.nullif("year", F.lit("")), F.regexp_extract("stem", r"^(\d{4})", 1))})
    number = F.when(F.col("volume") != "", F.concat(F.lit(", "), "volume", F.lit("("), F.coalesce(F.nullif("issue", F.lit("")), F.lit("?")), F.lit(")"), F.when(F.col("page") != "", F.concat(F.lit(": "), "page")).otherwise(""))).otherwise("")
    series = F.when((F.col("journal") != "") & (F.col("year") != ""), F.concat("journal", F.lit(", "), "year", number)).otherwise("")
    return d.select(
        "source_id", F.coalesce(F.nullif("title", F.lit("")), "stem").alias("title"), F.col("stem").alias("title_or_name"), "authors", series.alias("series"), F.col("journal").alias("publisher"), "year", "doi", "lang",
        F.concat(F.lit("file://"), F.regexp_replace("path", "^file:/*", "/")).alias("url"), F.lit("C1").alias("authority"), F.when(F.col("year").try_cast("int") >= 2018, "recent").otherwise("historical").alias("freshness"),
        F.lit(origin).alias("source_origin"), F.lit("confirmed").alias("access_status"), metadata_confidence().alias("meta_confidence"),
    )


def metadata_confidence() -> Column:
    """By how many of five fields are known; high needs authors."""
    known = sum(((F.coalesce(F.trim(F.col(c)), F.lit("")) != "").cast("int") for c in ("authors", "journal", "year", "volume")), (F.coalesce(F.trim("title"), F.lit("")) != "").cast("int"))
    return F.when((known >= 4) & (F.coalesce(F.trim("authors"), F.lit("")) != ""), "high").when(known >= 3, "medium").otherwise("low")


def keywords(topic: Column, stop: tuple[str, ...] = (), most: int = 5) -> Column:
    """The first words of a topic that are longer than two letters and no stop words."""
    words = F.filter(t.find_all(F.lower(topic), r"([\x{4e00}-\x{9fff}\w]+)"), lambda w: (F.length(w) > 2) & ~w.isin(*stop) if stop else F.length(w) > 2)
    return F.slice(words, 1, most)


def quote(text: Column, words: Column, least: int = 80, most: int = 500) -> Column:
    """The first sentence of fit length with the first keyword that any such sentence has."""
    fit = F.filter(F.split(text, r"(?<=[.!?])\s+", -1), lambda s: (F.length(s) > least) & (F.length(s) < most))
    found = F.filter(F.transform(words, lambda w: F.get(F.filter(fit, lambda s: F.contains(F.lower(s), w)), F.lit(0))), lambda s: s.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def diagrams(docs: DataFrame) -> DataFrame:
    """(doc_id, block, code) of the Mermaid blocks of texts."""
    return docs.select("doc_id", F.posexplode(t.find_all(F.col("text"), r"(?s)```mermaid\n(.*?)```")).alias("block", "code"))


def wide_labels(code: Column, most: int = 28, first: int = 5) -> Column:
    """Labels that are wider than a box shows, the first few."""
    return F.slice(F.filter(t.find_all(code, r"\[\"?([^\]\"]+)\"?\]"), lambda x: t.width(x) > most), 1, first)


def _ratio(a: str | None, b: str | None) -> float:
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


@F.pandas_udf(T.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which Spark lacks."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def bare_title(text: Column) -> Column:
    return F.rtrim(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), F.lit("."))


def _shared(a: Column, b: Column) -> Column:
    """Characters that two texts share, as multisets: no common subsequence is longer."""
    count = lambda x, ch: F.length(x) - F.length(F.replace(x, ch, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "(?<=.)(?=.)")), F.lit(0), lambda n, ch: n + F.when(ch == "", 0).otherwise(F.least(count(a, ch), count(b, ch))))


def _prefix(a: Column, b: Column) -> Column:
    """Characters that two texts begin with alike: the longest common block is no shorter."""
    pairs = F.zip_with(F.split(a, "(?<=.)(?=.)"), F.split(b, "(?<=.)(?=.)"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(pairs, False)
    return F.when(first > 0, first - 1).otherwise(F.size(pairs))


#: difflib leaves frequent characters of longer texts out, so that only shorter ones have a lower bound.
_JUNK_FREE = 200


def ratio_bounds(a: Column, b: Column) -> tuple[Column, Column]:
    """What Ratcliff-Obershelp similarity is at least and at most: by the common beginning or containment, and by length and characters shared."""
    total = F.length(a) + F.length(b)
    contained = F.when((F.length(b) > 0) & F.contains(a, b), F.length(b)).when((F.length(a) > 0) & F.contains(b, a), F.length(a)).otherwise(0)
    low = F.when(F.length(b) < _JUNK_FREE, 2 * F.greatest(contained, _prefix(a, b)) / total).otherwise(0.0)
    return F.when(total > 0, low).otherwise(1.0), F.when(total > 0, 2 * _shared(a, b) / total).otherwise(1.0)


def title_pairs(entries: DataFrame, sources: DataFrame, least: float = 0.6) -> DataFrame:
    """Entries (doc_id, source_id, entry) beside the corpus's title under the same id, with both readings and `unlike`: true or false where bounds decide, else null."""
    title = filled(F.col("title_or_name"), F.col("title")) if "title_or_name" in sources.columns else F.col("title")
    before = F.get(F.split(F.regexp_replace("entry", r"^\[S\d+\]", ""), "http", 2), F.lit(0))
    stop = F.instr(before, ". ")
    d = entries.join(sources.select("source_id", bare_title(title).alias("known")), "source_id").where(F.col("known") != "")
    d = d.withColumns({"whole": bare_title(before), "first": bare_title(F.when(stop > 0, F.substring(before, F.lit(1), stop - 1)).otherwise(before))})
    known = F.col("known")
    bounds = [ratio_bounds(F.col(x), known) for x in ("whole", "first")]
    alike = (bounds[0][0] >= least) | (bounds[1][0] >= least)
    return d.withColumn("unlike", F.when(alike, False).when((bounds[0][1] < least) & (bounds[1][1] < least), True))


def title_mismatches(entries: DataFrame, sources: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, source_id, score) of entries whose title is unlike the corpus's under the same id, by the better of two readings.

    Bounds leave most pairs that are alike out; of the rest, Python gives the score. `title_or_name` goes before `title`, where the sources have it.
    """
    d = title_pairs(entries, sources, least).where(F.coalesce("unlike", F.lit(True)))
    d = d.withColumn("score", F.greatest(title_ratio("whole", "known"), title_ratio("first", "known")))
    return d.where(F.col("score") < least).select("doc_id", "source_id", "score")


def mismatched_ids(entries: DataFrame, sources: DataFrame, least: float = 0.6) -> DataFrame:
    """J11 without scores: (doc_id, source_id). Python sees only pairs that lie between the bounds.

    Drafts write a source's entry alike: each different entry is compared once, however many drafts have it.
    """
    d = title_pairs(entries.select("source_id", "entry").distinct(), sources, least)
    between = d.where(F.col("unlike").isNull()).where(F.greatest(title_ratio("whole", "known"), title_ratio("first", "known")) < least)
    unlike = d.where("unlike").select("source_id", "entry").unionByName(between.select("source_id", "entry"))
    return entries.join(unlike, ["source_id", "entry"]).select("doc_id", "source_id")


def text_with_header(source_id: Column, title: Column, url: Column, text: Column, truncated: Column | None = None) -> Column:
    """SK5: a text file of a source: id and title, URL, size and a rule, then the text."""
    cut = F.lit(False) if truncated is None else F.coalesce(truncated, F.lit(False))
    size = F.concat(F.lit("Chars: "), F.length(text).cast("string"), F.when(cut, " (TRUNCATED)").otherwise(""))
    return F.concat(F.lit("["), source_id, F.lit("] "), title, F.lit("\nURL: "), F.coalesce(url, F.lit("")), F.lit("\n"), size, F.lit("\n" + "=" * 60 + "\n\n"), text)


def text_written_back(corpus: DataFrame, extracted: DataFrame) -> DataFrame:
    """SK5: the corpus with what became of each source's text: `extracted` has (source_id, path, chars, truncated, quote), one row a source.

    Sources without a row keep nulls; a blank quote says nothing.
    """
    e = extracted.select("source_id", F.lit(True).alias("pdf_text_extracted"), F.col("chars").alias("pdf_text_chars"), F.col("path").alias("pdf_text_path"), F.col("truncated").alias("pdf_text_truncated"), F.when(F.trim("quote") != "", F.col("quote")).alias("verified_quote"))
    return corpus.join(e, "source_id", "left")


def is_pdf(content: Column) -> Column:
    """by the first bytes."""
    return F.coalesce(F.startswith(content, F.lit(b"%PDF")), F.lit(False))
