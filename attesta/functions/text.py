"""Column expressions over text: white space, markers, hashes, file names, widths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as both engines of the oracle can write it: ASCII, no-break and ideographic space.
WS = r"[\s\x{00a0}\x{3000}]"
_WS_CHARS = " \t\n\x0b\f\r\u00a0\u3000"
SOURCE_MARK = r"\[S(\d+)\](?!\()"
NUMBER_MARK = r"(?<!\[)[\[（](\d{1,3})[\]）](?!\()"
GAP_MARK = r"\[G(\d+)\]"
BARE_GAP_MARK = r"(?<![\[A-Za-z])G(\d+)(?![\]\d])"
ROUND_SOURCE_MARK, ROUND_GAP_MARK = r"\[R(\d+)-S(\d+)\]", r"\[R(\d+)-G(\d+)\]"
CJK = r"[\x{4e00}-\x{9fff}]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is computed once for a row, however often and within whatever lambda `f` uses it.

    An expression within a lambda is evaluated for each element, and a column that one lambda alone refers to is put in its place by the optimizer.
    """
    return F.transform(F.array(value), f)[0]


def find_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def replaced(text: Column, pattern: str, by: str, holds: str) -> Column:
    """`regexp_replace` of a pattern whose every match `holds` that part: it is tried on texts that have it."""
    return let(text, lambda x: F.when(F.contains(x, F.lit(holds)), F.regexp_replace(x, pattern, by)).otherwise(x))


def dense_length(text: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.translate(text, _WS_CHARS, ""))


def normalized_quote(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def quote_hash(text: Column) -> Column:
    """Of a quotation, however it is laid out."""
    return F.concat(F.lit("sha256:"), F.sha2(normalized_quote(text).cast("binary"), 256))


def to_half_width(text: Column) -> Column:
    """Full-width letters, digits and signs as ASCII."""
    full = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　"
    half = "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)) + " "
    return F.translate(text, full, half)


def file_part(text: Column, most: int = 90) -> Column:
    """A text as part of a file name."""
    out = F.regexp_replace(text, r'[\\/:*?"<>|]+', " ")
    out = F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), " ", "_")
    out = F.btrim(F.substring(F.regexp_replace(out, "_+", "_"), 1, most), F.lit("._"))
    return F.when(out == "", "untitled").otherwise(out)


def file_name(source_id: Column, title: Column) -> Column:
    return F.concat(file_part(source_id, 24), F.lit("_"), file_part(title, 96), F.lit(".pdf"))


def lines_where(text: Column, pattern: str, holds: str = "") -> Column:
    """Places of the lines that match when trimmed, from 0. What every match `holds` is sought first: the pattern is tried on lines that have it."""
    return places_where(F.split(text, "\n", -1), pattern, holds)


def places_where(lines: Column, pattern: str, holds: str = "") -> Column:
    """The same of a text that was split before."""
    fits = lambda x: F.contains(x, F.lit(holds)) & F.trim(x).rlike(pattern)
    return F.filter(F.transform(lines, lambda x, i: F.when(fits(x), i)), lambda i: i.isNotNull())


def line_range(text: Column, start: Column, stop: Column) -> Column:
    """Lines from start to before stop, joined."""
    return joined_range(F.split(text, "\n", -1), start, stop)


def joined_range(lines: Column, start: Column, stop: Column) -> Column:
    """The same of a text that was split before."""
    return F.array_join(F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0))), "\n")


def width(text: Column) -> Column:
    """Columns a label takes: ideographs take two."""
    return F.length(text) + count(text, CJK)


def html_section(html: Column, keyword: str) -> Column:
    """P5: from the first second-level heading whose text has the keyword to the next one of that level; null without such a heading.

    The page is split before each heading. A heading's text is what stands between its tags, without other tags.
    """
    parts = F.split(html, r"(?=<h2[^>]*>)", -1)
    heading = lambda p: F.regexp_replace(F.regexp_extract(p, r"(?s)^<h2[^>]*>(.*?)</h2>", 1), r"<[^>]+>", "")
    return F.get(F.filter(parts, lambda p: F.contains(heading(p), F.lit(keyword))), F.lit(0))
