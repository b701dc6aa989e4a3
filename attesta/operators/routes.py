"""Technical routes: diagrams as tables of nodes and edges, their levels, and what they lock in the body.

A diagram is part of one document's text, so it is taken apart within its row: drafts aren't shuffled, whatever their number. The Mermaid subset that routes use is read: nodes with a label in
brackets, arrows with or without text, chains, several nodes joined by `&`, subgraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as t

# The fence of diagrams, a node with its label, arrows, layers that a label names, marks of gaps, the body section that solves the problems, and how many of each.
FENCE = r"(?ms)^\s*```mermaid[^\n]*\n(.*?)^\s*```"
NODE = r'(?U)([\w-]+)\s*(?:\[|\(|\{)+\s*("[^"\n]*"|[^"\]\)\}\n]*)\s*(?:\]|\)|\})+'
ARROW = r"\s*(?:<?-->|---|-\.->|==>|--\s[^-\n]*\s-->)\s*(?:\|[^|\n]*\|)?\s*"
SUBGRAPH = r"(?m)^\s*subgraph\s"
PROBLEMS, TECHNOLOGIES, LAYER = "^问题层", "^技术层", "^(输入层|问题层|技术层|验证层|成果层|总目标)[：:]?"
GAPS = r"\s*(待补证|待验证|待内部确认)\s*$"
SOLUTIONS = r"^##\s.*关键技术问题与解决方案"
N_PROBLEMS = N_TECHNOLOGIES = MAX_LEVELS = 3
_NODE = "struct<id:string,label:string>"
_EDGE = "struct<src:string,dst:string>"


def _lines(diagram: Column) -> Column:
    """Statements of a diagram without its comments, subgraph and style lines."""
    lines = F.transform(F.split(diagram, r"[\n;]", -1), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(%%|subgraph\b|end$|flowchart\b|graph\b|direction\b|style\b|classDef\b|class\b|linkStyle\b)"))


def nodes_of(diagram: Column) -> Column:
    """Nodes with a label, in the order of their ids; the longest label counts where several are given."""
    ids, labels = t.find_all(diagram, NODE, 1), t.find_all(diagram, NODE, 2)
    pairs = F.array_distinct(F.zip_with(ids, labels, lambda i, x: F.struct(i.alias("id"), F.btrim(x, F.lit('" ')).alias("label"))))
    longer = lambda m, n: (F.length(m["label"]) > F.length(n["label"])) | ((F.length(m["label"]) == F.length(n["label"])) & (m["label"] > n["label"]))
    return t.let(pairs, lambda ps: F.array_sort(F.filter(ps, lambda n: F.size(F.filter(ps, lambda m: (m["id"] == n["id"]) & longer(m, n))) == 0)))


def edges_of(diagram: Column) -> Column:
    """(src, dst) of each arrow; a chain has one between all neighbours, `&` joins each of one side to each of the other."""
    bare = F.regexp_replace(diagram, NODE, "$1")
    sides = F.transform(F.filter(_lines(bare), lambda x: x.rlike(ARROW)), lambda x: F.transform(F.split(x, ARROW, -1), lambda s: F.filter(F.transform(F.split(s, "&", -1), lambda y: F.regexp_extract(F.trim(y), r"(?U)^([\w-]+)", 1)), lambda y: y != "")))
    pairs = F.transform(sides, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda i: F.struct(F.get(s, i).alias("a"), F.get(s, i + 1).alias("b"))))
    each = F.transform(F.flatten(pairs), lambda p: F.flatten(F.transform(p["a"], lambda x: F.transform(p["b"], lambda y: F.struct(x.alias("src"), y.alias("dst"))))))
    return F.array_distinct(F.flatten(each))


def diagrams(docs: DataFrame) -> DataFrame:
    """`docs` with the first diagram's text (null without one), nodes and edges."""
    d = docs.withColumn("diagram", F.get(t.find_all(F.col("text"), FENCE), F.lit(0)))
    return d.withColumns({"nodes": nodes_of(F.col("diagram")), "edges": edges_of(F.col("diagram"))})


def levels(nodes: Column, edges: Column) -> Column:
    """(id, level) of each node that a root leads to: roots, which no edge enters, have level 1, others one more than the nearest node before them.

    Breadth first, a level a step, until a step adds nothing new: a cycle that no root leads to has no level.
    """
    every = F.array_distinct(F.concat(F.transform(nodes, lambda n: n["id"]), F.transform(edges, lambda e: e["src"]), F.transform(edges, lambda e: e["dst"])))
    entered = F.transform(F.filter(edges, lambda e: e["src"] != e["dst"]), lambda e: e["dst"])
    front = lambda xs, n: F.transform(xs, lambda x: F.struct(x.alias("id"), n.cast("int").alias("level")))
    start = lambda roots: F.struct(front(roots, F.lit(1)).alias("seen"), roots.alias("front"))

    def step(s: Column, n: Column) -> Column:
        known = F.transform(s["seen"], lambda x: x["id"])
        new = F.array_except(F.transform(F.filter(edges, lambda e: F.array_contains(s["front"], e["src"])), lambda e: e["dst"]), known)
        # Steps after the last new node have an empty front and add nothing.
        return F.when(F.size(s["front"]) == 0, s).otherwise(F.struct(F.concat(s["seen"], front(new, n + 1)).alias("seen"), new.alias("front")))

    walk = lambda ids, roots: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))), start(roots), step, lambda s: s["seen"])
    return t.let(every, lambda ids: t.let(F.array_except(ids, entered), lambda roots: walk(ids, roots)))


def headings(text: Column) -> Column:
    """Headings of all levels without their numbers, outside of fences."""
    return F.transform(t.find_all(F.regexp_replace(text, r"(?ms)^\s*```.*?^\s*```", ""), r"(?m)^#{1,6}\s+(.*?)\s*$"), lambda h: F.regexp_replace(h, r"^(第\s*[一二三四五六七八九十\d]+\s*章|\d+(\.\d+)*[.、]?)\s*", ""))


def bare_label(label: Column) -> Column:
    """A node's label without its layer and gap mark."""
    return F.trim(F.regexp_replace(F.regexp_replace(label, LAYER, ""), GAPS, ""))


def edge_table(docs: DataFrame) -> DataFrame:
    """(doc_id, src, dst, level): the edges of all diagrams, with the level that the source has."""
    d = diagrams(docs).withColumn("levels", levels(F.col("nodes"), F.col("edges")))
    d = d.select("doc_id", "levels", F.explode("edges").alias("e"))
    return d.select("doc_id", "e.src", "e.dst", F.get(F.filter("levels", lambda x: x["id"] == F.col("e.src")), F.lit(0))["level"].alias("level"))


def route_lock(docs: DataFrame) -> DataFrame:
    """What is wrong with each route: (doc_id, n_nodes, depth, problems, technologies, solutions, unheaded, citing, hidden_gaps, cyclic, passed).

    `depth` counts levels: of subgraphs, if the diagram has any, else of edges from the roots. `problems` and `technologies` are the activities below the problem and the technology layer, `solutions` the headings
    of the body's section of solutions. `unheaded` are labels that no heading has, `citing` those with source marks, `hidden_gaps` those whose gap mark stands beside no gap of the body, `cyclic`
    nodes that no root leads to. A document without a diagram fails with nulls.
    """
    d = diagrams(docs).withColumns({"levels": levels(F.col("nodes"), F.col("edges")), "_prose": F.regexp_replace("text", FENCE, "")})
    nodes, edges, prose, first = F.col("nodes"), F.col("edges"), F.col("_prose"), F.col("_first")
    d = d.withColumns({"_first": F.get(t.lines_where(prose, SOLUTIONS), F.lit(0)), "_n_lines": F.size(F.split(prose, "\n", -1))})
    ids = lambda p: F.transform(F.filter(nodes, lambda n: n["label"].rlike(p)), lambda n: n["id"])
    below = lambda p: t.let(ids(p), lambda above: t.let(ids(LAYER), lambda layers: F.size(F.array_distinct(F.transform(F.filter(edges, lambda e: F.array_contains(above, e["src"]) & ~F.array_contains(layers, e["dst"])), lambda e: e["dst"])))))
    n_subgraphs = t.count(F.col("diagram"), SUBGRAPH)
    deepest = F.coalesce(F.array_max(F.transform("levels", lambda x: x["level"])), F.lit(0))
    every = F.array_distinct(F.concat(F.transform(nodes, lambda n: n["id"]), F.transform(edges, lambda e: e["src"]), F.transform(edges, lambda e: e["dst"])))
    stop = F.get(F.filter(t.lines_where(prose, r"^##\s"), lambda i: i > first), F.lit(0))
    section = t.let(F.coalesce(stop, F.col("_n_lines")), lambda end: t.line_range(prose, first, end))
    gap_lines = F.filter(F.split(prose, "\n", -1), lambda x: x.rlike(t.GAP_MARK))
    marked = F.array_distinct(F.transform(F.filter(nodes, lambda n: n["label"].rlike(GAPS)), lambda n: bare_label(n["label"])))
    labels = F.array_distinct(F.transform(nodes, lambda n: bare_label(n["label"])))
    d = d.withColumns({
        "n_nodes": F.size(every), "depth": F.when(n_subgraphs > 0, n_subgraphs).otherwise(deepest), "problems": below(PROBLEMS), "technologies": below(TECHNOLOGIES),
        "solutions": F.coalesce(t.count(section, r"(?m)^###\s"), F.lit(0)),
        "unheaded": F.array_sort(F.array_except(F.filter(labels, lambda x: x != ""), headings(F.col("text")))),
        "citing": F.array_sort(F.transform(F.filter(nodes, lambda n: n["label"].rlike(t.SOURCE_MARK)), lambda n: n["label"])),
        "hidden_gaps": t.let(gap_lines, lambda lines: F.array_sort(F.filter(marked, lambda y: ~F.exists(lines, lambda x: F.contains(x, y))))),
        "cyclic": F.array_sort(F.array_except(every, F.transform("levels", lambda x: x["id"]))),
    })
    empty = lambda *xs: [F.size(x) == 0 for x in xs]
    passed = (F.col("problems") == N_PROBLEMS) & (F.col("technologies") == N_TECHNOLOGIES) & (F.col("solutions") == F.col("problems") + F.col("technologies")) & (F.col("depth") <= MAX_LEVELS)
    for x in empty("unheaded", "citing", "hidden_gaps", "cyclic"):
        passed = passed & x
    there = F.col("diagram").isNotNull()
    out = [F.when(there, F.col(x)).alias(x) for x in ("n_nodes", "depth", "problems", "technologies", "solutions", "unheaded", "citing", "hidden_gaps", "cyclic")]
    return d.select("doc_id", *out, F.coalesce(there & passed, F.lit(False)).alias("passed"))
