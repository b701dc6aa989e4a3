"""Enumerations, thresholds and schemas of the claim-evidence model."""

from __future__ import annotations

from pyspark.sql import types as T

# The vocabulary of claims, evidence and sources.
CLAIM_CLASSES = ("E", "M", "N", "L", "D", "C", "U", "J")
RISKS = ("R0", "R1", "R2", "R3", "R4")
AUTHORITIES = ("A1", "A2", "A3", "B1", "B2", "C1", "C2", "D1", "D2")
PRIMARY_AUTHORITIES = ("A1", "A2", "A3", "B1", "B2")
FRESHNESS = ("current", "recent", "historical", "superseded", "unknown")
SUPPORT_LEVELS = ("direct", "strong_inference", "weak_inference", "context_only", "contradictory", "unsupported")
RELATIONS = ("supports", "contradicts", "context_only")
CONFIDENCES = ("high", "medium", "low")
LOCATOR_QUALITIES = ("high", "medium", "low")
LOCATOR_KEYS = ("page", "section", "paragraph", "quote_hash", "locator_quality")
VERIFICATION_MODES = ("live", "static")
SOURCE_ORIGINS = ("registry", "discovered", "user", "emergent")
NEEDS_SOURCE = ("E", "M", "N", "L")

# Points of the evidence score, in tenths.
AUTHORITY_TENTHS = {"A1": 10, "A2": 9, "A3": 8, "B1": 7, "B2": 6, "C1": 5, "C2": 4, "D1": 3, "D2": 2}
LEVEL_TENTHS = {"direct": 10, "strong_inference": 8, "weak_inference": 5}
FRESHNESS_TENTHS = {"current": 10, "recent": 7, "historical": 4, "superseded": 1}
OTHER_AUTHORITY, OTHER_LEVEL, OTHER_FRESHNESS = 4, 3, 3
GRADES = ((90, "Strong"), (75, "Good"), (60, "Moderate"), (40, "Weak"))
LOWEST_GRADE = "Insufficient"

# Evidence that each risk asks for: primary sources, independent sources, live check, contradiction coverage.
TIERS = {"R0": (0, 0, False, False), "R1": (0, 1, False, False), "R2": (1, 2, False, True), "R3": (1, 2, True, True), "R4": (2, 2, True, True)}
DEFAULT_TIER = (0, 1, False, False)
#: Review mode: multiplier of the thresholds, live check for all claims.
REVIEW_MODES = {"conservative": (1.5, True), "balanced": (1.0, False), "exploratory": (0.7, False)}
#: Least authority by risk.
AUTHORITY_FLOOR = {"R2": "B1", "R3": "A2", "R4": "A1"}

# Least sources and characters by document type.
DOC_MINIMUMS = {
    "proposal": (15, 6000), "thesis_ug": (20, 10000), "report_survey": (25, 10000), "report_feasibility": (15, 6000), "whitepaper": (12, 5000), "report_gf": (12, 10000),
    "plan_implementation": (12, 8000), "paper_journal": (16, 6000), "patent_disclosure": (8, 5000), "patent_application": (8, 5000), "thesis_ms": (40, 20000), "thesis_phd": (60, 35000),
}

# Parts of URLs that make a source suspect, in order; and suffixes of hosts.
SUSPECT_DOMAINS = (
    "bjjcyjy", "antpedia", "stm-publishing", "baike.baidu", "baike.com", "zhihu.com", "q.wenku", "wenku.baidu", "docin.com", "doc88.com",
    "wikipedia", "futunn", "openai.com/blog", "anthropic.com/research", "samaltman", "36kr", "jiqizhixin", "sohu.com", "163.com", "toutiao",
)
SUSPECT_SUFFIXES = (".test", ".localhost", ".example", ".invalid")

# Authority and priority by category, and by source id.
CATEGORY_RANKS = {
    "international_regulator": ("A1", 100), "china_regulator": ("A1", 95), "international_standard": ("A2", 90), "china_standard": ("A3", 88), "international_industry": ("B1", 85),
    "industry_technical": ("B1", 80), "government_agency": ("B1", 78), "national_lab": ("B1", 76), "technical_report_library": ("B1", 75), "nuclear_data": ("B1", 72),
    "cross_technical_report_library": ("B1", 70), "energy_international": ("B1", 68), "energy_data": ("B1", 66), "materials_data": ("B2", 65), "ai_policy": ("B1", 62),
    "materials_engineering_data": ("B2", 60), "materials_scientific_database": ("B2", 60), "ai_index": ("B1", 60), "ai_china_standard": ("A3", 58), "ai_research": ("C1", 55),
    "education_statistics": ("B1", 55), "education_research": ("B1", 50), "china_technical": ("B2", 50), "china_funding_repository": ("B1", 45), "china_tech_report_system": ("B1", 45), "scholarly_index": ("C1", 40),
}
SOURCE_RANKS = {
    "cnki": ("C1", 62), "wanfang": ("C1", 58), "cqvip": ("C1", 55), "doi_org": ("C1", 70), "iaea": ("A1", 100), "nrc": ("A1", 100), "nnsa": ("A1", 95), "epri": ("B1", 88), "oecd_nea": ("B1", 86),
    "ieee_standards": ("A2", 92), "iec": ("A2", 90), "iso": ("A2", 90), "astm": ("A2", 90), "icrp": ("A2", 90), "std_samr": ("A3", 88), "openstd_samr": ("A3", 86), "osti": ("B1", 78), "inis": ("B1", 76),
    "iaea_nds": ("B1", 72), "arxiv": ("C1", 50), "crossref": ("C1", 40),
}
DEFAULT_PRIORITY = 50

# Categories of the registry that each topic domain searches; none: all.
ROUTING = {
    "nuclear": ("international_regulator", "international_industry", "industry_technical", "nuclear_data", "china_regulator", "china_standard", "technical_report_library", "international_standard", "scholarly_index"),
    "materials": ("materials_data", "materials_engineering_data", "materials_scientific_database", "international_standard", "china_standard", "nuclear_data", "technical_report_library", "cross_technical_report_library", "scholarly_index"),
    "energy": ("energy_international", "energy_data", "government_agency", "national_lab", "china_regulator", "china_technical", "industry_technical"),
    "education": ("education_statistics", "education_research", "china_regulator", "scholarly_index"),
    "ai": ("ai_research", "ai_index", "ai_policy", "ai_standard", "ai_china_standard", "china_technical", "scholarly_index"),
    "funding": ("china_funding_repository", "china_tech_report_system", "cross_technical_report_library", "scholarly_index"),
    "engineering": ("international_standard", "china_standard", "technical_report_library", "cross_technical_report_library", "materials_engineering_data", "china_funding_repository"),
    "general": (),
}

# Access status by download status.
ACCESS_BY_DOWNLOAD = {"downloaded": "confirmed", "exists": "confirmed", "not_pdf": "web_accessible", "failed": "unavailable"}

LOCATOR = T.StructType([
    T.StructField("page", T.IntegerType()), T.StructField("section", T.StringType()), T.StructField("paragraph", T.IntegerType()),
    T.StructField("quote_hash", T.StringType()), T.StructField("locator_quality", T.StringType()),
])
SOURCE = T.StructType([T.StructField(x, T.StringType()) for x in (
    "source_id", "title", "title_or_name", "url", "type", "authority", "freshness", "access_status", "source_level", "source_origin", "registry_id", "publisher", "year",
    "authors", "series", "volume", "issue", "page", "doi", "lang", "title_en", "authors_en", "journal_en", "series_en", "city", "role",
)])
_LIST = T.ArrayType(T.StringType())
CLAIM = T.StructType([
    *[T.StructField(x, T.StringType()) for x in ("claim_to_write", "section", "claim_class", "risk", "evidence_status", "confidence", "interpretation", "verification_mode")],
    T.StructField("source_support_levels", T.MapType(T.StringType(), T.StringType())), T.StructField("source_relations", T.MapType(T.StringType(), T.StringType())),
    T.StructField("source_locators", T.MapType(T.StringType(), LOCATOR)),
    T.StructField("counter_evidence", T.StructType([T.StructField(x, _LIST) for x in ("evidence_for", "evidence_against", "unknown")])),
    T.StructField("counter_evidence_search", T.StringType()), T.StructField("counter_search", T.StringType()),
    T.StructField("reconciliation", T.StructType([T.StructField(x, T.StringType()) for x in ("support_summary", "contradiction_summary", "verdict", "rationale")])),
])
