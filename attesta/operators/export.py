"""What an exported document's Markdown and HTML go through: citations raised, URLs linked, references wrapped, the kind of review told at its foot.

All are expressions over one text. HTML is taken as tags and the text between them: texts are changed, tags and their attributes never.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.evidence import lookup

# Tags, URLs in text, citation marks that are no links, footnotes or parts of words, headings of references in Markdown and in HTML.
TAG, URL = r"<[^>]+>", r"(https?://[^\s<>\"']+)"
CITATION = r"(?<![!A-Za-z0-9\[^])\[(\d{1,3}(?:[-–,，]\d{1,3})*)\](?!\()"
REFS_HEADING = r"(?mU)^#{1,6}\s*(?:\d+[.、]\s*)?(参考文献|References|Bibliography)\b"
REFS_H2, H2 = r"<h2[^>]*>[^<]*参考文献[^<]*</h2>", r"<h2[^>]*>"
# Kinds of review and what a document says of its bounds.
REVIEW_KINDS = {"ai-internal": "同模型角色隔离（内部红队，不等同独立评审）", "ai-cross-model": "跨模型独立审查（共享 context/evidence 时仍存在相关失败风险）", "human-expert": "人类专家评审"}
NOT_TOLD = "未声明（--manifest 提供时自动标注）"
BOUNDARY = "边界声明：本报告由 evidence-suite 校验「引用原文是否支持论断」，不保证来源网页/论文内容本身真实；quote_hash/页码等 locator 可能因 PDF 版本、扫描件或网页改版失效；未找到反证不等于论断正确。"
FOOTER_STYLE = "margin-top:3em;padding-top:0.6em;border-top:0.5pt solid #999;font-size:8pt;color:#666;line-height:1.6"


def _cut(text: Column, at: Column) -> tuple[Column, Column]:
    """What stands before a place, counted from 1, and from it on."""
    return F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.length(text))


def superscript_citations(text: Column) -> Column:
    """Marks [n], [1-4], [2,5] before the reference heading as <sup>; without a heading in the whole text."""
    at = F.regexp_instr(text, F.lit(REFS_HEADING))
    raised = lambda x: F.regexp_replace(x, CITATION, "<sup>[$1]</sup>")
    head, tail = _cut(text, at)
    return F.when(at == 0, raised(text)).otherwise(F.concat(raised(head), tail))


def tokens(html: Column) -> Column:
    """(text, tag): each text of a page and the tag that ends it, an empty one at last."""
    tags = F.regexp_extract_all(html, F.lit(TAG), F.lit(0))
    return F.zip_with(F.split(html, TAG, -1), tags, lambda x, tag: F.struct(x.alias("text"), F.coalesce(tag, F.lit("")).alias("tag")))


def linkify(html: Column) -> Column:
    """URLs in texts as links. A text that begins with a stray < counts as a tag."""
    linked = lambda x: F.when(x.startswith("<"), x).otherwise(F.regexp_replace(x, URL, '<a href="$1">$1</a>'))
    return F.array_join(F.transform(tokens(html), lambda x: F.concat(linked(x["text"]), x["tag"])), "")


def wrap_references(html: Column) -> Column:
    """The first section whose second-level heading names the references, up to the next heading of that level, in a section of class refs."""
    at = F.regexp_instr(html, F.lit(REFS_H2))
    head, rest = _cut(html, at)
    inside = F.length(F.regexp_extract(rest, f"^{REFS_H2}", 0))
    after = F.substring(rest, inside + 1, F.length(rest))
    next_ = F.regexp_instr(after, F.lit(H2))
    body, tail = _cut(rest, F.when(next_ == 0, F.length(rest) + 1).otherwise(inside + next_))
    return F.when(at == 0, html).otherwise(F.concat(head, F.lit('<section class="refs">'), body, F.lit("</section>"), tail))


def review_label(kind: Column) -> Column:
    """A kind of review in words; a kind that isn't known stays as it is."""
    return F.when(F.coalesce(kind, F.lit("")) == "", NOT_TOLD).otherwise(F.coalesce(lookup(kind, REVIEW_KINDS, None), kind))


def review_footer(html: Column, kind: Column) -> Column:
    """The kind of review and the bounds of the check, before each end of a body."""
    foot = F.concat(F.lit(f"<div style='{FOOTER_STYLE}'>评审类型："), review_label(kind), F.lit(f"<br/>{BOUNDARY}</div></body>"))
    return F.replace(html, F.lit("</body>"), foot)


def exported(html: Column, kind: Column) -> Column:
    """A page as it is delivered."""
    return review_footer(wrap_references(linkify(html)), kind)
