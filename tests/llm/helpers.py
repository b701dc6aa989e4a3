"""A small corpus with all that can be odd about documents."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the th ing er on an re ed and ha to or ti es at".split(), "de": "der die ung sch ein zu ver heit ge en ü ö ß tz".split(), "fr": "le la é è ou que tion eau oi de an re ai eux".split()}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(seed: int = 1, n: int = 90) -> list[tuple]:
    rng = random.Random(seed)
    passage = "\n".join(sentence(rng, "en", 30) for _ in range(5))
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        lines = [sentence(rng, lang, rng.randint(3, 30)) + "." for _ in range(rng.randint(1, 8))]
        if i % 7 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if i % 11 == 0:
            lines.append(f"token = \"{rng.randbytes(20).hex()}\" and AKIA{'Q7' * 9} api-key: {'abc' * 5}")
        if i % 13 == 0:
            lines.append("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64)))
        rows.append((i, "\n".join(lines), lang, rng.choice(["b", "a", "c"])))
    text = rows[3][1]
    rows += [(n + j, text, "en", "a") for j in range(4)]
    rows += [(n + 4, text.replace(" ", "  ", 1) + " one", "en", "a"), (n + 5, None, "en", "b"), (n + 6, "", None, None), (n + 7, " \t\n\v ", "de", "a"), (n + 8, "word", "en", None), (n + 9, "ab" * 40_000, "en", "a"), (n + 10, "same words " * 900, "fr", "a")]
    rows += [(5, "another text under an id that is taken", "en", "c"), rows[7], rows[7], (None, rows[9][1], None, "a"), (n + 11, "É ß ſ K Σς İ \u0301x \x1c y\x85z \u3000 <|endoftext|> don't 12,5 ﬁ 한국 e\u0301", "fr", "c")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def table(spark, rows: list[tuple] | None = None):
    """With columns whose names an operator might use for itself."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    return df.withColumns({x: F.lit("own") for x in ("key", "size", "n", "h", "word", "ids", "label", "start", "spans", "bucket", "fingerprint", "target")})


def saved(spark, path, rows: list[tuple] | None = None) -> str:
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    return str(path)
