"""Documents: chapters and their depth, sections of a paper and its scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as t

CHAPTER = r"^##\s*(?:第\s*[一二三四五六七八九十\d]+\s*章|[\d]+[.、])\s*(.*)$"
# Chapters that need not develop a frame; words in headings, then in prose, that show each element.
EXEMPT = r"(绪论|引言|前言|总结|展望|结论|摘要|ABSTRACT|目录|致谢|参考文献|研究局限|攻读)"
SKELETON = {
    "目标": (("目标", "目的", "任务", "要求", "总体目标"), ("目标", "目的", "任务", "要求")),
    "方法": (("方法", "手段", "活动", "措施", "方案", "技术路线"), ("方法", "手段", "活动", "措施", "方案", "技术", "模型", "算法")),
    "输入输出": (("输入", "输出", "流程", "过程", "步骤", "实施"), ("输入", "输出", "流程", "过程", "步骤", "实施")),
    "标准依据": (("标准依据", "依据", "标准", "规范", "准则", "要求"), ("标准", "规范", "依据", "准则", "要求", "导则", "规程")),
}


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): the lines of texts."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def carried(lines: DataFrame, label: Column) -> DataFrame:
    """`lines` with the last label at or before each line, null before the first."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("label", F.last(label, ignorenulls=True).over(w))


def chapters(docs: DataFrame) -> DataFrame:
    """(doc_id, chapter, title, block) of each chapter; what stands before the first is no chapter.

    A document's lines stay in its row: headings split the text into blocks.
    """
    head = F.col("line")
    marks = t.lines_where(F.col("text"), CHAPTER)
    d = docs.select("doc_id", "text", marks.alias("marks"), F.size(F.split("text", "\n", -1)).alias("n")).select("*", F.posexplode("marks").alias("chapter", "start"))
    d = d.withColumn("block", t.line_range(F.col("text"), F.col("start"), F.coalesce(F.get("marks", F.col("chapter") + 1), F.col("n"))))
    d = d.withColumn("line", F.trim(F.get(F.split("block", "\n", -1), F.lit(0))))
    return d.select("doc_id", "chapter", F.trim(F.regexp_extract(head, CHAPTER, 1)).alias("title"), "block").where(F.col("title") != "")


def framework_depth(docs: DataFrame, min_chars: int = 1200, min_missing: int = 1) -> DataFrame:
    """Chapters that aren't exempt, with their size and the elements they lack. A heading that names an element is enough."""
    d = chapters(docs).where(~F.col("title").rlike(EXEMPT))
    heads = F.array_join(t.find_all(F.col("block"), r"(?m)^###\s+([^#].*)$"), "\n")
    d = d.withColumns({"heads": heads, "chars": t.dense_length(F.col("block"))})
    named = lambda c, words: F.col(c).rlike("|".join(words))
    missing = F.array_compact(F.array(*[F.when(~(named("heads", h) | named("block", p)), F.lit(name)) for name, (h, p) in SKELETON.items()]))
    d = d.withColumns({"missing": missing, "thin": F.col("chars") < min_chars})
    return d.withColumn("passed", (F.size("missing") < min_missing) & ~F.col("thin")).drop("heads", "block")


# What a section's line begins with, and the sections it opens.
MARKER = r"(?i)^[#*\s]{0,10}(摘\s*要|Abstract\s*[:：]?|关\s*键\s*词|Key\s*words|参\s*考\s*文\s*献|References|【参\s*考\s*文\s*献】)\*{0,2}\s*[:：]?\s*"
CODE = "^(中图分类号|文献[标志标识码别])"
SECTIONS = ("front", "abs", "kw", "abs_en", "kw_en", "body", "concl", "refs")
#: A letter for each section, by which lines are marked.
_LETTER = dict(zip(SECTIONS, "faksebcr", strict=True))


#: First characters of lines that MARKER may fit: it is tried on no other line.
_FIRST = r"[#*\s摘Aa关Kk参Rr【]"


def any_lines(text: Column) -> Column:
    """The lines of a text, whatever ends them. Only texts with carriage returns are searched by a pattern."""
    return F.split(F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text), "\n", -1)


def _facts(line: Column) -> Column:
    """{s, kind, line} of a line: trimmed; the letter of the section that its marker opens, `!` for a code, 1 for a heading below the first level, 2 for a conclusion's, 3 for both, 0 for another."""
    x = _LETTER

    def of(s: Column) -> Column:
        head = F.lower(F.regexp_replace(F.regexp_extract(s, MARKER, 1), r"[\s:：]", ""))
        opened = F.when(head == "摘要", x["abs"]).when(head == "abstract", x["abs_en"]).when(head == "关键词", x["kw"]).when(head == "keywords", x["kw_en"]).otherwise(x["refs"])
        below, concl = s.rlike(r"^#{2,6}\s"), s.rlike(r"^#{1,6}\s*\d+(\.\d+)*\s*.*(结论|结语)")
        heading = (below.cast("int") + 2 * concl.cast("int")).cast("string")
        first = F.substring(s, 1, 1)
        kind = F.when(first.rlike(_FIRST) & s.rlike(MARKER), opened).when(first.isin("中", "文") & s.rlike(CODE), "!").when(first == "#", heading).otherwise("")
        return F.struct(s.alias("s"), kind.alias("kind"), line.alias("line"))

    return t.let(F.trim(line), of)


def sections(text: Column) -> Column:
    """Array of {m, l}: each line's text and the letter of its section.

    Two of the changes depend on the section before, so that lines are folded in order; the fold carries one letter a line. What a line is by itself is told
    once before the fold; the fold reads a line only in keywords and abstracts.
    """
    x = _LETTER
    opens = list("akser")

    def step(acc: Column, e: Column) -> Column:
        kind, s = e["kind"], e["s"]
        before_body = acc["mode"].isin(*[x[m] for m in ("front", "abs_en", "kw_en", "kw", "abs")])
        m = F.when(kind.isin("1", "3") & before_body, x["body"]).otherwise(acc["mode"])
        m = F.when(kind.isin("2", "3") & (m == x["body"]), x["concl"]).otherwise(m)

        def read(m: Column) -> Column:
            long = m.isin(x["kw"], x["kw_en"]) & ~s.contains("；") & ~s.contains(";") & (F.length(s) > 40)
            english = (m == x["abs"]) & ~s.rlike(t.CJK) & (t.count(s, "[A-Za-z]") > 30)
            return F.when(long, F.when(s.contains("引言"), x["body"]).otherwise(x["front"])).when(english, x["abs_en"]).otherwise(m)

        mode = F.when(kind.isin(*opens), kind).when(kind == "!", m).otherwise(t.let(m, read))
        return t.let(mode, lambda n: F.struct(n.alias("mode"), F.concat(acc["out"], F.when(kind == "!", x["front"]).otherwise(n)).alias("out")))

    def kept(e: Column, m: Column) -> Column:
        line = F.when(e["kind"].isin(*opens), F.nullif(F.regexp_replace(e["s"], MARKER, ""), F.lit(""))).when(e["kind"] == "!", e["s"]).otherwise(e["line"])
        return F.struct(m.alias("m"), line.alias("l"))

    def lettered(facts: Column) -> Column:
        start = F.struct(F.lit(x["front"]).alias("mode"), F.lit("").alias("out"))
        letters = F.filter(F.split(F.aggregate(facts, start, step, lambda acc: acc["out"]), ""), lambda m: m != "")
        return F.zip_with(facts, letters, kept)

    # A marker with nothing behind it is no line of its section.
    return F.filter(t.let(F.transform(any_lines(text), _facts), lettered), lambda e: e["l"].isNotNull())


def with_sections(docs: DataFrame) -> DataFrame:
    """`docs` with a column for each of SECTIONS; the body ends at its own appendix."""
    d = docs.withColumn("_s", sections(F.col("text")))

    def lines(mode: str) -> Column:
        return F.array_join(F.transform(F.filter("_s", lambda x: x["m"] == _LETTER[mode]), lambda x: x["l"]), "\n")

    d = d.withColumns({m: lines(m) for m in SECTIONS}).drop("_s")
    return d.withColumn("body", F.get(F.split("body", r"(?m)^#{1,6}\s*附\s*录.*$", 2), F.lit(0)))


ENTRY = r"^\[?\d+\]?[\s.、]|^\[S[-_]?\d+\]"


def entries(refs: Column) -> Column:
    """Reference entries; a line that begins none goes on with the entry before. The first line begins one in any case."""
    lines = F.filter(F.split(refs, "\n", -1), lambda x: F.trim(x) != "")
    lines = F.transform(lines, lambda x: F.trim(F.ltrim(F.trim(x), F.lit("#*- "))))
    marked = F.transform(lines, lambda x, i: F.when((i == 0) | x.rlike(ENTRY), F.concat(F.lit("\x01"), x)).otherwise(F.concat(F.lit(" "), x)))
    return F.filter(F.split(F.array_join(marked, ""), "\x01", -1), lambda x: x != "")


# Least references, characters and share of bilingual entries of a tier, and whether it needs figures and equations.
STYLE_TIERS = {"top": (20, 8000, 0.5, True, True), "mid": (10, 6000, 0.2, False, False)}
HARD_ITEMS = ("S1", "S3", "S6", "S8", "S10", "S11", "S17")
PASS_RATIO = 0.85


def scorecard(docs: DataFrame, tier: str = "mid") -> DataFrame:
    """`docs` with S1 to S17, each 0 to 2 points."""
    least_refs, least_chars, least_share, need_figures, need_equations = STYLE_TIERS[tier]
    d = with_sections(docs).withColumn("entries", entries(F.col("refs")))
    text, abstract = F.col("text"), F.col("abs")
    has = lambda c, p: F.col(c).rlike(p).cast("int")
    parts = has("abs", "针对|为了|为明确|为解决|旨在") + has("abs", "提出|构建|建立|采用|基于|设计|开发") + has("abs", r"(\d+(\.\d+)?\s*[%％])|(≤|≥|误差|精度.{0,6}\d|下降\s*\d|提升\s*\d|降低\s*\d)") + has("abs", "表明|验证|证实|结果|可得出|可用于")
    kw = F.size(F.filter(F.split("kw", "[;；]", -1), lambda x: x.rlike(t.CJK)))
    english = (F.trim("abs_en") != "").cast("int") + (F.trim("kw_en") != "").cast("int") + has("text", r"(?m)^[#*\s]{0,6}\**[A-Z][A-Za-z0-9,\-() ]{15,}\**\s*$")
    numbers = F.filter(F.transform(t.find_all(text, r"(?m)^##\s*(\d+)\s+[^\d.]"), lambda x: x.cast("int")), lambda x: x > 0)
    d = d.withColumns({"_n": numbers, "_last": F.element_at(F.concat(F.array(F.lit("")), t.find_all(text, r"(?m)^(##\s*\d+[\s、.].*)$")), -1)})
    order = lambda xs: F.size(xs).eqNullSafe(0) | (xs == F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1))))
    in_order = (F.size("_n") > 0) & order(F.col("_n"))
    refs = F.size("entries")
    share = lambda xs, of: F.when(F.size(of) > 0, F.size(xs) / F.size(of)).otherwise(0.0)
    tagged = F.filter("entries", lambda e: e.rlike(r"\[(?:J|M|S|D|C|R|N|EB|DB|CP|A)/?[^\]]*\]"))
    chinese = F.filter("entries", lambda e: e.rlike(t.CJK))
    tail = lambda e: F.element_at(F.split(e, "—", -1), -1)
    both = F.filter("_chinese", lambda e: e.rlike(r"[\x{4e00}-\x{9fff}].*[.]\s*[A-Z][a-z]+.{20,}") & tail(e).rlike(r"[A-Za-z]{4,}[\s,:].*[A-Za-z]{4,}"))
    firsts = lambda p: F.array_distinct(F.transform(t.find_all(text, p), lambda x: x.cast("int")))
    # What several conditions read is a column: computed once a row.
    d = d.withColumns({"_figures": firsts(r"图\s*(\d+)"), "_tables": firsts(r"表\s*(\d+)"), "_chinese": chinese})
    figures, tables = F.col("_figures"), F.col("_tables")
    fig_ok, tab_ok = order(figures), order(tables)
    with_figures = (F.size(figures) > 0) if need_figures else F.lit(True)
    d = d.withColumn("_lines", F.filter(F.transform(any_lines(text), lambda x: F.trim(x)), lambda x: x != ""))
    # A caption and the line after it.
    pairs = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(r"^图\s*\d+"), F.concat(x, F.lit("\n"), F.when(F.get("_lines", i + 1).rlike("(?i)^(Fig|表|Tab)"), F.get("_lines", i + 1)).otherwise("")))), lambda x: x.isNotNull())
    equations = F.array_sort(F.array_distinct(F.transform(t.find_all(F.col("body"), r"(?m)[（(](\d{1,2})[)）]\s*(?:$|[^)）])"), lambda x: x.cast("int"))))
    d = d.withColumns({"_pairs": pairs, "_equations": equations, "_tagged": share(tagged, F.col("entries")), "_both": share(both, F.col("_chinese"))})
    pairs, equations = F.col("_pairs"), F.col("_equations")
    captioned = F.filter(pairs, lambda x: x.rlike(r"(?i)Fig\.?\s*\d"))
    where = t.count(text, r"式\s*中\s*[:：]")
    hits = text.contains("众所周知").cast("int") + F.regexp_replace(text, r"参考文献[\s\S]*", "").contains("我们").cast("int") + abstract.rlike("首次|填补空白|国际领先").cast("int")
    d = d.withColumns({
        "_han": t.count(abstract, t.CJK), "_parts": parts, "_kw": kw, "_english": english, "_points": t.count(F.col("concl"), r"[（(]\d[)）]|[①②③④⑤⑥⑦]"),
        "_chars": t.dense_length(F.col("body")) + t.dense_length(F.col("concl")), "_captioned": F.size(captioned),
    })
    n, parts, kw, english, points, chars = (F.col(x) for x in ("_han", "_parts", "_kw", "_english", "_points", "_chars"))
    two = lambda full, half: F.when(full, 2).when(half, 1).otherwise(0)
    items = {
        "S1": two(n.between(150, 350), n.between(100, 450)), "S2": two(parts == 4, parts >= 2), "S3": two(kw.between(5, 6), kw.between(3, 8)),
        "S4": text.contains("中图分类号").cast("int") + (text.contains("文献标志码") | text.contains("文献标识码")).cast("int"), "S5": two(english == 3, english == 2),
        "S6": two(text.rlike(r"(?m)^#{1,6}\s*0\s*引\s*言"), text.rlike(r"(?m)^#{1,6}\s*引\s*言")), "S7": two(in_order & (F.size("_n") >= 2), F.size("_n") > 0), "S8": F.when(F.col("_last").rlike("结论|结语"), 2).otherwise(0),
        "S9": two(points >= 3, points >= 1), "S10": two(refs >= least_refs, refs >= 0.7 * least_refs), "S11": two(F.col("_tagged") >= 0.9, F.col("_tagged") >= 0.6),
        "S12": two(F.col("_both") >= least_share, F.col("_both") >= 0.1), "S13": two(fig_ok & tab_ok & with_figures, fig_ok | tab_ok),
        "S14": F.when((F.size(pairs) > 0) & (5 * F.col("_captioned") >= 4 * F.size(pairs)), 2).when(F.col("_captioned") > 0, 1).otherwise(0 if need_figures else 2),
        "S15": F.when(F.size(equations) == 0, 0 if need_equations else 2).when(order(equations) & (where >= F.greatest(F.lit(1), F.floor(F.size(equations) / 2))), 2).otherwise(1),
        "S16": 2 - F.least(F.lit(2), hits), "S17": two(chars >= least_chars, chars >= 0.6 * least_chars),
    }
    d = d.withColumns(items)
    total = sum((F.col(x) for x in list(items)[1:]), F.col("S1"))
    hard = F.lit(True)
    for x in HARD_ITEMS:
        hard = hard & (F.col(x) > 0)
    return d.withColumn("total", total).withColumn("passed", (F.col("total") / (2 * len(items)) >= PASS_RATIO) & hard)


# Words that sell, by severity; a sentence with a critical one and no citation stops a draft.
TRIGGERS = {
    "critical": ("国际领先", "填补空白", "革命性突破", "颠覆性", "首创", "开辟新领域", "划时代", "根本性解决"),
    "high": ("重大意义", "广阔前景", "显著提升", "极大改善", "突破瓶颈", "完美解决", "必将推动"),
    "medium": ("具有重要意义", "有效促进", "明显提高"),
}
# Phrases of templates, as patterns, and whether a citation in the sentence excuses them.
TEMPLATE_PHRASES = (
    ("拓展了.{0,20}的理论边界", False), ("丰富了.{0,20}的应用场景", False), ("可为.{0,20}提供参考|具有重要的参考价值", False), ("填补了.{0,20}的空白", True),
    ("具有重要的理论意义和实践意义", False), ("对.{0,20}具有深远影响", False), ("在前人基础上", True), ("本研究弥补了上述不足", False),
)
CITED = r"\[S?\d+\]"


def triggers(sentences: DataFrame, words: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, pos, severity, word, cited, blocks) for each trigger word in a sentence (doc_id, pos, sentence)."""
    table = [(severity, w) for severity, ws in (words or TRIGGERS).items() for w in ws]
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("sentence"), F.lit(w)), F.struct(F.lit(severity).alias("severity"), F.lit(w).alias("word"))) for severity, w in table]))
    d = sentences.withColumn("cited", F.col("sentence").rlike(CITED)).select("doc_id", "pos", F.explode(found).alias("hit"), "cited")
    return d.select("doc_id", "pos", "hit.severity", "hit.word", "cited", ((F.col("hit.severity") == "critical") & ~F.col("cited")).alias("blocks"))


def template_phrases(sentences: DataFrame) -> DataFrame:
    """(doc_id, pos, phrase) for each banned phrase in a sentence that no citation excuses; `phrase` counts from 1."""
    cited = F.col("sentence").rlike(CITED)
    hits = [F.when(F.col("sentence").rlike(p) & (~cited if excused else F.lit(True)), F.lit(i)) for i, (p, excused) in enumerate(TEMPLATE_PHRASES, 1)]
    return sentences.select("doc_id", "pos", F.explode(F.array_compact(F.array(*hits))).alias("phrase"))


# Document types by the words of a request, in order; a thesis and a patent have kinds of their own.
DOC_ROUTES = (
    (("国防科技报告", "GF报告", "GF 报告", "GF Report", "科技报告"), "report_gf"), (("实施方案", "implementation plan"), "plan_implementation"), (("期刊论文", "期刊", "投稿", "修回稿", "journal"), "paper_journal"),
    (("专利", "交底书", "发明创造", "实用新型", "patent"), "patent"), (("白皮书", "技术报告", "技术白皮书", "whitepaper"), "whitepaper"), (("调研", "综述", "现状", "survey", "review"), "report_survey"),
    (("可行", "可研", "论证", "可行性", "feasibility"), "report_feasibility"), (("方案", "立项", "申报", "项目", "proposal"), "proposal"), (("论文", "学位", "thesis", "ug", "master", "phd", "本科", "硕士", "博士", "学士"), "thesis"),
)
PATENT_ROUTES = ((("申请草案", "权利要求书", "说明书摘要", "claims"), "patent_application"),)
THESIS_ROUTES = ((("博士", "phd"), "thesis_phd"), (("硕士", "master"), "thesis_ms"), (("本科", "学士", "ug", "undergraduate"), "thesis_ug"))
RESEARCH_ROUTES = ((("理论",), "理论"), (("实证", "实验", "调查"), "实证"))
# Reviewers by the words of a topic; and those of a topic without any.
EXPERT_ROUTES = (
    (("人工智能", "机器学习", "深度学习", "神经网络", "大模型", "算法", "数据", "传感信号", "智能监测"), "ai"), (("幼儿", "教育", "教学", "课程", "学习", "学生", "教师", "体育", "游戏", "学前"), "education"),
    (("工程", "设备", "传感器", "系统", "架构", "安全", "核", "电缆", "老化"), "engineering"), (("材料", "能源", "动力", "电池", "电力", "化工", "冶金"), "engineering"),
    (("经费", "预算", "资金", "资助", "财政", "投资", "采购"), "social_science"), (("临床", "疾病", "药物", "流行病", "卫生", "患者", "健康", "医学"), "medical"), (("政策", "法规", "经济", "社会", "治理", "管理", "市场"), "social_science"),
)
EXPERT_DEFAULT = ("education", "engineering")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def routed(text: Column, routes: tuple[tuple[tuple[str, ...], str], ...], default: str) -> Column:
    """The target of the first route, in order, that has a word in the text."""
    out = F.lit(default)
    for words, target in reversed(routes):
        out = F.when(_holds(text, words), target).otherwise(out)
    return out


def document_type(request: Column) -> Column:
    """The template that a request asks for."""
    first = routed(request, DOC_ROUTES, "proposal")
    return F.when(first == "patent", routed(request, PATENT_ROUTES, "patent_disclosure")).when(first == "thesis", routed(request, THESIS_ROUTES, "thesis_ug")).otherwise(first)


def research_type(request: Column) -> Column:
    """Of a thesis, the kind of research; else null."""
    return F.when(document_type(request).startswith("thesis_"), routed(request, RESEARCH_ROUTES, "混合"))


def experts(topic: Column, routes: tuple[tuple[tuple[str, ...], str], ...] = EXPERT_ROUTES, default: tuple[str, ...] = EXPERT_DEFAULT, most: int = 2) -> Column:
    """Up to `most` different reviewers whose words the topic holds; none: the default."""
    found = F.array_distinct(F.array_compact(F.array(*[F.when(_holds(topic, ws), F.lit(x)) for ws, x in routes])))
    return F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(F.array(*[F.lit(x) for x in default]))
