"""Export transforms against regular expressions of Python."""

import random
import re

from pyspark.sql import functions as F

from attesta.operators import export

PARTS = ["<p>", "</p>", '<a href="http://a.org/x">', "http://b.org/y?z=1&q=(2)", "https://c.org/é", "text ", " ", "<", ">", "\n", "<h2>", "</h2>", '<h2 id="k">3. 参考文献', "参考文献", "</body>", "'", '"', "ftp://no", "HTTP://up", "<br/>", "$1 \\1"]
MARKS = ["[1]", "[2-4]", "[5，6]", "[1234]", "[7](u)", "![8]", "x[9]", "字[10]", "[^1]", "[[11]]", "\n# References\n", "\n## 2、参考文献\n", "\n#### Bibliographyx\n", " ", "\n", "-"]


def random_texts(parts, n=500):
    rng = random.Random(len(parts))
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)] + [""]


def results(spark, texts, f):
    d = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, t string")
    return [r[0] for r in d.select(f(F.col("t")), "i").orderBy("i").collect()]


def linkified(html):
    return "".join(x if x.startswith("<") else re.sub(r"(https?://[^\s<>\"']+)", r'<a href="\1">\1</a>', x) for x in re.split(r"(<[^>]+>)", html))


def wrapped(html):
    m = re.search(r"<h2[^>]*>[^<]*参考文献[^<]*</h2>", html)
    if not m:
        return html
    after = re.search(r"<h2[^>]*>", html[m.end() :])
    stop = m.end() + after.start() if after else len(html)
    return f'{html[: m.start()]}<section class="refs">{html[m.start() : stop]}</section>{html[stop:]}'


def raised(text):
    m = re.search(r"^#{1,6}\s*(?:\d+[.、]\s*)?(参考文献|References|Bibliography)\b", text, re.M)
    head, tail = (text[: m.start()], text[m.start() :]) if m else (text, "")
    return re.sub(r"(?<![!A-Za-z0-9\[^])\[(\d{1,3}(?:[-–,，]\d{1,3})*)\](?!\()", r"<sup>[\1]</sup>", head) + tail


def test_links_and_references(spark):
    texts = random_texts(PARTS)
    assert results(spark, texts, export.linkify) == [*map(linkified, texts), None]
    assert results(spark, texts, export.wrap_references) == [*map(wrapped, texts), None]
    assert sum("section" in wrapped(x) for x in texts) > 3


def test_superscripts(spark):
    texts = random_texts(MARKS)
    assert results(spark, texts, export.superscript_citations) == [*map(raised, texts), None]


def test_footer(spark):
    d = spark.createDataFrame([("a</body>b</body>", "human-expert"), ("none", "x"), ("</body>", None), ("</body>", "panel")], "h string, k string")
    got = [r[0] for r in d.select(export.review_footer(F.col("h"), F.col("k"))).collect()]
    assert got[0].count("人类专家评审") == 2 and got[1] == "none" and "未声明" in got[2] and "评审类型：panel<br/>" in got[3] and got[3].endswith("</div></body>")
