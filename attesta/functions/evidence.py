"""Column expressions over claims and evidence edges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import contracts as k


def lookup(key: Column, table: Mapping, other: object) -> Column:
    """The table's value for a key, else `other`: a CASE, so that it stays in generated code."""
    out = None
    for x, y in table.items():
        out = F.when(key == x, F.lit(y)) if out is None else out.when(key == x, F.lit(y))
    return out.otherwise(F.lit(other)) if out is not None else F.lit(other)


def blank(x: Column) -> Column:
    """Empty and null are one: missing."""
    return F.coalesce(F.trim(x), F.lit("")) == ""


def filled(*xs: Column) -> Column:
    """The first that isn't blank, trimmed; else the empty string."""
    return F.coalesce(*[F.when(~blank(x), F.trim(x)) for x in xs], F.lit(""))


def relation_of(level: Column, explicit: Column | None = None) -> Column:
    """What an edge says of its claim; a given relation wins over the derived one."""
    derived = F.when(level == "contradictory", "contradicts").when(level == "context_only", "context_only").otherwise("supports")
    return derived if explicit is None else F.coalesce(F.when(explicit != "", explicit), derived)


def has_locator(page: Column, section: Column, paragraph: Column, quote_hash: Column) -> Column:
    """Zero and blank are no place, nor is a quality alone."""
    return (F.coalesce(page, F.lit(0)) != 0) | (F.coalesce(section, F.lit("")) != "") | (F.coalesce(paragraph, F.lit(0)) != 0) | (F.coalesce(quote_hash, F.lit("")) != "")


def place_of(edges: DataFrame) -> dict[str, Column]:
    """The fields of a locator, null where the edges have no such column."""
    types = {f.name: f.dataType for f in k.LOCATOR.fields}
    return {x: F.col(x) if x in edges.columns else F.lit(None).cast(types[x]) for x in k.LOCATOR_KEYS}


def located(edges: DataFrame) -> Column:
    """Whether an edge names a place in its source."""
    place = place_of(edges)
    return has_locator(*[place[x] for x in ("page", "section", "paragraph", "quote_hash")])


def given_place(edges: DataFrame) -> Column:
    """Whether an edge has any field of a locator, be it empty: that much makes it traceable. So does a locator that was recorded with nulls only."""
    some = F.coalesce(F.col("recorded"), F.lit(False)) if "recorded" in edges.columns else F.lit(False)
    for x in place_of(edges).values():
        some = some | x.isNotNull()
    return some


def id_of(edges: DataFrame) -> Column:
    """The id that an edge names its source by; a bare number is that of a source."""
    if "source_id" in edges.columns:
        return F.col("source_id")
    key = F.col("source_key").cast("string")
    return F.when(key.rlike(r"^\d+$"), F.concat(F.lit("S"), key)).otherwise(key)


def is_primary(authority: Column) -> Column:
    return F.coalesce(authority.isin(*k.PRIMARY_AUTHORITIES), F.lit(False))


def grade_of(score: Column) -> Column:
    out = F.lit(k.LOWEST_GRADE)
    for least, name in reversed(k.GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def balance_of(support: Column, against: Column, context: Column) -> Column:
    """A mark for how a claim's edges stand to each other."""
    return F.when(against > support, "−").when((support > 0) & (against == 0), "+").when((support > 0) & (against > 0), "±").when(context > 0, "=").otherwise("?")


def coverage(against: Column, unknown: Column, searches: list[Column], contradiction_summary: Column, rationale: Column) -> Column:
    """Whether a claim's contradictions were looked for.

    `searches` are the raw JSON of search logs: a list or an object that isn't empty counts, a
    string if it names counter-evidence.
    """
    some = (F.coalesce(F.size(against), F.lit(0)) > 0) | (F.coalesce(F.size(unknown), F.lit(0)) > 0)
    for raw in searches:
        text = F.coalesce(F.trim(raw), F.lit(""))
        nested = text.rlike(r"^(?s)[\[{].*[\]}]$") & ~text.rlike(r"^(\[\s*\]|\{\s*\})$")
        some = some | nested | (~text.rlike(r"^[\[{]") & text.contains("反证"))
    why = F.coalesce(F.trim(rationale), F.lit(""))
    return some | ~blank(contradiction_summary) | why.contains("反证") | why.contains("未找到") | why.contains("未发现")
