"""Narrative patterns as patterns over rows of sentences.

Each sentence of a paragraph becomes a token: a letter for each signal in it, in order of where the signal first stands, and a semicolon. A paragraph is then one short string, and a pattern over sentences is a
regular expression over it: `P`, then `O` within so many sentences, then `F`. `matches` gives the place of each match back in sentences. Other rules can bring letters and patterns of their own.
Everything about a document is an expression over its row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as t

# Signals of sentences, by letter: the old way, one's own project, a future, what is certain, a condition, the only way, a cited source, an inference, a conclusion of worth, a marked assumption.
SIGNALS = {
    "P": "传统方法|痛点", "O": "本项目|本课题|本研究", "F": "未来|前景|趋势|广泛应用|产业升级", "W": "将", "A": "必然|必定|一定|必将|全面", "C": "若|如果|假设|前提|条件", "U": "只有|唯一|必须",
    "S": t.SOURCE_MARK, "I": "必然|因此|从而|由此|意味着|受益", "V": "价值|意义|效益|潜力", "H": r"\[假设\]|\[G\d+\]",
}
#: Sentences between two signals of a journey, at most.
NEAR = 3
SENTENCE_END = r"(?<=[。！？!?；])|\n"
COMPARISON = r"(?m)^\s*\|.*\|\s*$"
_BEGIN = "(?<![^;])"
_SAME, _HOP = "[^;]*", f"[^;]*;(?:[^;]*;){{0,{NEAR}}}?[^;]*"
_NOT = lambda letters: f"[^;{letters}]*"
#: A token without any of some letters but with one of them all.
_BARE = lambda one, no: f"{_NOT(no)}{one}{_NOT(no)};"
#: Name: (pattern over tokens, risk).
PATTERNS = {
    # Problem, own project, future, in this order, near each other.
    "N1": (f"P(?:{_SAME}|{_HOP})O(?:{_SAME}|{_HOP})F", "high"),
    # A cited observation, uncited inferences, an uncited conclusion that isn't marked as an assumption.
    "N2": (f"{_SAME}S{_SAME};(?:{_BARE('I', 'SHV')})+{_BARE('V', 'SH')}", "critical"),
    # A future that is certain, without a condition or a mark.
    "N3": (f"{_BEGIN}(?:{_NOT('CH')}[FW]{_NOT('CH')}A|{_NOT('CH')}A{_NOT('CH')}[FW]){_NOT('CH')};", "high"),
    "N4": (f"{_BEGIN}{_NOT('H')}U{_NOT('H')};", "medium"),
}


def sentences(text: Column) -> Column:
    """Paragraphs as arrays of sentences that aren't blank; tables, headings and fences are no prose."""
    prose = F.regexp_replace(F.regexp_replace(text, r"(?ms)^\s*```.*?^\s*```", ""), r"(?m)^\s*(\||#{1,6}\s).*$", "\n")
    parts = F.transform(F.split(prose, r"\n\s*\n", -1), lambda p: F.filter(F.transform(F.split(p, SENTENCE_END, -1), lambda s: F.trim(s)), lambda s: s != ""))
    return F.filter(parts, lambda p: F.size(p) > 0)


def token(sentence: Column, signals: Mapping[str, str] = SIGNALS) -> Column:
    """The letters of a sentence's signals, in order of their first place, and a semicolon."""
    found = F.array(*[F.struct(F.regexp_instr(sentence, F.lit(p)).alias("at"), F.lit(letter).alias("letter")) for letter, p in signals.items()])
    return F.concat(F.array_join(F.transform(F.array_sort(F.filter(found, lambda x: x["at"] > 0)), lambda x: x["letter"]), ""), F.lit(";"))


def matches(tokens: Column, pattern: str) -> Column:
    """(first, last): sentences of each match within a paragraph's tokens, from 0; matches don't overlap."""
    # Each match is closed by a mark; what stands before a mark, match included, ends at the match's last sentence.
    marked = F.regexp_replace(tokens, f"({pattern})", "\u0001$1\u0002")
    pieces = F.split(marked, "\u0002", -1)
    semicolons = lambda x: F.length(x) - F.length(F.translate(x, ";", ""))
    before = lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda a, p: a + semicolons(p))
    inner = lambda p: F.element_at(F.split(p, "\u0001", -1), -1)
    spans = F.transform(pieces, lambda p, i: F.when(F.contains(p, F.lit("\u0001")), F.struct((before(i) + semicolons(p) - semicolons(inner(p))).alias("first"), (before(i) + semicolons(p) - F.when(p.endswith(";"), 1).otherwise(0)).alias("last"))))
    return F.array_compact(spans)


def row_patterns(docs: DataFrame, signals: Mapping[str, str] = SIGNALS, patterns: Mapping[str, tuple[str, str]] = PATTERNS) -> DataFrame:
    """(doc_id, paragraph, pattern, risk, first, last, excerpt): each match of each pattern, its sentences counted within their paragraph."""
    d = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("paragraph", "s"))
    d = d.withColumn("tokens", F.array_join(F.transform("s", lambda x: token(x, signals)), ""))

    def named(name: str, pattern: str, risk: str) -> Column:
        return F.transform(matches(F.col("tokens"), pattern), lambda m: F.struct(F.lit(name).alias("pattern"), F.lit(risk).alias("risk"), m["first"].alias("first"), m["last"].alias("last")))

    found = F.concat(*[named(name, p, risk) for name, (p, risk) in patterns.items()])
    d = d.select("doc_id", "paragraph", "s", F.explode(found).alias("m"))
    return d.select("doc_id", "paragraph", "m.*", F.array_join(F.slice("s", F.col("m.first") + 1, F.col("m.last") - F.col("m.first") + 1), "").alias("excerpt"))


def narratives(docs: DataFrame) -> DataFrame:
    """`row_patterns` of N1 to N4; one way (N4) is none where the document compares ways in a table."""
    compared = docs.where(F.col("text").rlike(COMPARISON)).select("doc_id", F.lit("N4").alias("pattern"))
    return row_patterns(docs).join(compared, ["doc_id", "pattern"], "left_anti")
