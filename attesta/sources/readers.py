"""Readers: corpora, evidence maps, drafts, registries, PDF files. Schemas are given, never inferred."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta import contracts as k
from attesta.functions.evidence import filled, relation_of
from attesta.sources.checkpoints import settled

#: Keys under which a file may keep its sources, in the order in which they are read, and keys that make an object a source.
SOURCE_LISTS = ("sources", "core_sources", "supporting_sources", "context_only_sources", "lead_only_sources", "needs_verification_sources", "candidate_sources", "selected_sources", "raw_sources", "items")
ID_KEYS = ("id", "source_id")
PDF_PAGES, PDF_CHARS = 500, 5_000_000
_ITEMS = "array<variant>"


def _members(v: Column) -> Column:
    """The members of an object, null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", _ITEMS)


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, v) of whole JSON files, a byte-order mark or not; v is null where a file is no JSON."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.input_file_name().alias("file"), F.try_parse_json(F.regexp_replace("value", "^\ufeff", "")).alias("v"))


def _entries(files: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(file, pos, v) of the entries of a root list, or of the lists under some keys of a root object, one after the other; places count all entries."""
    lists = [F.coalesce(_items(_members(F.col("v"))[x]), F.array().cast(_ITEMS)) for x in keys]
    return files.select("file", F.posexplode(F.coalesce(_items(F.col("v")), F.flatten(F.array(*lists)))).alias("pos", "v"))


def entry_problems(spark: SparkSession, path: str, keys: tuple[str, ...] = SOURCE_LISTS) -> DataFrame:
    """(file, pos, problem): what a reader passes over: files that are no JSON, roots that hold no entries, entries that are no objects. Everything else of the file is read."""
    files = json_files(spark, path)
    root = files.select("file", F.lit(None).cast("int").alias("pos"), F.when(F.col("v").isNull(), "no JSON").when(_items(F.col("v")).isNull() & _members(F.col("v")).isNull(), "root is neither object nor list").alias("problem"))
    odd = _entries(files, keys).select("file", "pos", F.when(_members(F.col("v")).isNull(), "entry is no object").alias("problem"))
    return root.unionByName(odd).where(F.col("problem").isNotNull())


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """SC1: one row for each source of JSON files, with its file and place. Entries that are no objects are passed over and counted in places; `entry_problems` names them."""
    e = _entries(json_files(spark, path), SOURCE_LISTS).where(_members(F.col("v")).isNotNull())
    return e.select("file", "pos", F.from_json(F.to_json("v"), k.SOURCE).alias("s")).select("file", "pos", "s.*")


def nested_sources(spark: SparkSession, path: str) -> DataFrame:
    """SC2: (file, place, source as JSON) of whatever has an id or a source_id, in lists or under the named keys of objects, sources included, at any depth.

    A level at a time, until a level has no entries; `place` has the steps from the root, so that sorting by it gives the order in which a file lists its sources.
    """
    here = json_files(spark, path).select("file", F.array().cast("array<int>").alias("place"), "v")
    found = None
    while True:
        d = settled(here.select("file", "place", "v", _members(F.col("v")).alias("m"), _items(F.col("v")).alias("items")))
        if found is not None and d.isEmpty():
            return found
        source = F.coalesce(F.map_contains_key("m", ID_KEYS[0]) | F.map_contains_key("m", ID_KEYS[1]), F.lit(False))
        level = d.where(source).select("file", "place", F.to_json("v").alias("source"))
        found = level if found is None else found.unionByName(level)
        lists = F.array(*[F.struct(F.lit(i).alias("key"), _items(F.col("m")[x]).alias("items")) for i, x in enumerate(SOURCE_LISTS)])
        lists = F.when(F.col("items").isNotNull(), F.array(F.struct(F.lit(-1).alias("key"), F.col("items").alias("items")))).otherwise(F.filter(lists, lambda x: x["items"].isNotNull()))
        each = d.select("file", "place", F.explode(lists).alias("l")).select("file", "place", F.col("l.key").alias("key"), F.posexplode("l.items").alias("i", "v"))
        # An object's lists hold objects; a list may hold lists.
        each = each.where((F.col("key") < 0) | _members(F.col("v")).isNotNull())
        here = each.select("file", F.concat("place", F.array("key", "i")).alias("place"), "v")


def evidence_map(spark: SparkSession, path: str) -> DataFrame:
    """One row for each claim of evidence maps, with its place and id; maps by source id stay maps.

    An entry that is no object has a place and an id, but no row: `entry_problems` with the key names it. A map that is none counts as empty, and so do a locator's fields of a wrong kind;
    `places_given` has the sources with a locator that is an object and not empty, whatever it holds.
    """
    e = _entries(json_files(spark, path), ("evidence_map",)).withColumn("m", _members(F.col("v"))).where(F.col("m").isNotNull())
    locators = F.map_filter(F.coalesce(_members(F.col("m")["source_locators"]), F.create_map().cast("map<string,variant>")), lambda _, x: F.size(_members(x)) > 0)
    # Locators are read one by one, so that an odd one leaves the others alone.
    plain = F.from_json(F.to_json(F.map_filter("m", lambda name, _: name != "source_locators")), k.CLAIM)
    c = e.select("file", "pos", plain.alias("c"), locators.alias("l")).select("file", "pos", "c.*", F.map_keys("l").alias("places_given"), F.transform_values("l", lambda _, x: F.from_json(F.to_json(x), k.LOCATOR)).alias("_l"))
    return c.withColumn("source_locators", F.col("_l")).drop("_l").withColumn("claim_id", F.format_string("C-%03d", F.col("pos") + 1))


def claims_and_edges(maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The claims and edges of the model from an evidence map; sources keep their ids as keys, edges their locators as recorded."""
    from attesta.functions.evidence import coverage

    c = F.col
    covered = coverage(c("counter_evidence.evidence_against"), c("counter_evidence.unknown"), [c("counter_evidence_search"), c("counter_search")], c("reconciliation.contradiction_summary"), c("reconciliation.rationale"))
    key = F.concat_ws("#", "file", "claim_id")
    mode = F.lower(F.trim(F.coalesce("verification_mode", F.lit(""))))
    verdict = filled(c("evidence_status"), c("reconciliation.verdict"))
    claims = maps.select(key.alias("claim_key"), "claim_id", F.coalesce(F.trim("risk"), F.lit("R1")).alias("risk"), F.trim(F.coalesce("claim_class", F.lit(""))).alias("claim_class"), mode.alias("verification_mode"), F.coalesce(covered, F.lit(False)).alias("covered"), F.col("file").alias("case_key"), F.trim(F.coalesce("claim_to_write", F.lit(""))).alias("claim_text"), "evidence_status", verdict.alias("verdict"), "confidence", "interpretation")
    e = maps.select(key.alias("claim_key"), F.explode("source_support_levels").alias("source_key", "support_level"), F.col("source_relations").alias("r"), F.col("source_locators").alias("l"), (F.col("places_given") if "places_given" in maps.columns else F.map_keys("source_locators")).alias("given"))
    place = F.col("l")[F.col("source_key")]
    return claims, e.select("claim_key", "source_key", F.col("source_key").alias("source_id"), "support_level", relation_of(F.col("support_level"), F.col("r")[F.col("source_key")]).alias("relation"), *[place[x].alias(x) for x in k.LOCATOR_KEYS], F.coalesce(F.array_contains("given", F.col("source_key")), F.lit(False)).alias("recorded"))


def corpus_sources(rows: DataFrame) -> DataFrame:
    """The sources of the model: of a repeated id the last row counts."""
    w = Window.partitionBy("source_id").orderBy(F.desc("file"), F.desc("pos"))
    last = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return last.select(F.col("source_id").alias("source_key"), "source_id", F.trim(F.coalesce("authority", F.lit(""))).alias("authority"), F.trim(F.coalesce("freshness", F.lit(""))).alias("freshness"), filled(F.col("title_or_name"), F.col("title")).alias("title"), F.trim(F.coalesce("url", F.lit(""))).alias("url"))


@F.pandas_udf(T.StringType())
def _gb18030(contents: pd.Series) -> pd.Series:
    return contents.map(lambda b: None if b is None else bytes(b).decode("gb18030", "replace"))


def drafts(spark: SparkSession, path: str) -> DataFrame:
    """SC4, SC9: (doc_id, text) of Markdown files, UTF-8 or else GB18030."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    # Python sees the bytes of the other files only.
    text = F.coalesce(utf8, _gb18030(F.when(utf8.isNull(), F.col("content"))))
    return files.select(F.col("path").alias("doc_id"), text.alias("text"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """SC7: registry rows (id, category, name, url, allowFullText), whether or not the root is wrapped."""
    row = T.StructType([*[T.StructField(x, T.StringType()) for x in ("id", "name", "category", "url")], T.StructField("allowFullText", T.BooleanType())])
    inner = [T.StructField("authoritativeSources", T.ArrayType(row))]
    schema = T.StructType([*inner, T.StructField("writingSourceList", T.StructType(inner))])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode(F.coalesce("writingSourceList.authoritativeSources", "authoritativeSources")).alias("r")).select("r.*")


def _pages(content: bytes) -> Iterator[str]:
    try:
        import pdfplumber
    except ImportError:
        from PyPDF2 import PdfReader

        for page in PdfReader(io.BytesIO(content)).pages:
            yield page.extract_text() or ""
        return
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages:
            yield page.extract_text() or ""


def capped(pages: Iterator[str], max_pages: int = PDF_PAGES, max_chars: int = PDF_CHARS) -> tuple[str, bool]:
    """Pages joined by blank lines up to both caps, and whether a cap cut anything."""
    kept: list[str] = []
    size = 0
    for i, page in enumerate(pages):
        if i >= max_pages or size >= max_chars:
            return "\n\n".join(kept)[:max_chars], True
        kept.append(page)
        size += len(page) + 2
    text = "\n\n".join(kept)
    return text[:max_chars], len(text) > max_chars


def pdf_texts(files: DataFrame, max_pages: int = PDF_PAGES, max_chars: int = PDF_CHARS) -> DataFrame:
    """SC10: (path, text, chars, truncated, error) of PDF files (path, content); needs pdfplumber or PyPDF2 on the executors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    text, cut = capped(_pages(content), max_pages, max_chars)
                    rows.append((path, text, len(text), cut, None))
                except Exception as e:  # one bad file is a row, not the end of the job
                    rows.append((path, "", 0, False, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "text", "chars", "truncated", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, text string, chars long, truncated boolean, error string")
