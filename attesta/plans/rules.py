"""Rule files: reading, layering, and what is derived from them. They are small and stay on the driver."""

from __future__ import annotations

import copy
import json
import math
from pathlib import Path
from typing import Any

from attesta import contracts as k

DEFAULTS: dict[str, Any] = {
    "evidence_sufficiency": {r: dict(zip(("min_primary_sources", "min_independent_sources", "live", "contradiction_coverage"), t, strict=True)) for r, t in k.TIERS.items()},
    "review_modes": {m: {"evidence_multiplier": x, "live_for_all": live} for m, (x, live) in k.REVIEW_MODES.items()},
    "doc_minimums": {d: {"min_sources": s, "min_chars": n} for d, (s, n) in k.DOC_MINIMUMS.items()},
    "suspect_domains": list(k.SUSPECT_DOMAINS),
    "suspect_domain_suffixes": list(k.SUSPECT_SUFFIXES),
    "framework_depth": {"min_chars_per_chapter": 1200},
    "risk_tiers": {r: {"authority_min": k.AUTHORITY_FLOOR.get(r, ""), "live": r in ("R3", "R4")} for r in k.RISKS},
    # What each profile changes.
    "scenario_profiles": {
        "medical": {
            "risk_tiers": {"R2": {"authority_min": "A2", "live": True}, "R3": {"authority_min": "A1", "live": True}},
            "doc_minimums": {"paper_journal": {"min_sources": 20, "min_chars": 5000}, "report_survey": {"min_sources": 30, "min_chars": 12000}},
            "suspect_domains_extra": ["jianshu.com", "toutiao.com", "zhihu.com"],
        },
        "journal_top": {"doc_minimums": {"paper_journal": {"min_sources": 20, "min_chars": 8000}}, "journal_style": {"tier": "top"}},
        "general_tech": {
            "risk_tiers": {"R3": {"authority_min": "B1", "live": False}},
            "doc_minimums": {"proposal": {"min_sources": 10, "min_chars": 4000}, "report_survey": {"min_sources": 15, "min_chars": 6000}, "whitepaper": {"min_sources": 8, "min_chars": 3000}},
            "stop_rule": {"max_extra_before_diminishing": 6},
        },
    },
}


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    named = {"true": True, "false": False, "null": None, "~": None, "": None}
    if text.lower() in named:
        return named[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def _uncommented(line: str) -> str:
    quote = ""
    for i, ch in enumerate(line):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def parse_yaml(text: str) -> Any:
    """The subset of YAML that rule files use: nested mappings, lists of scalars, inline lists, comments."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in (_uncommented(line).rstrip() for line in text.splitlines()) if x.strip()]

    def block(at: int, indent: int) -> tuple[Any, int]:
        if rows[at][1].startswith("- ") or rows[at][1] == "-":
            items = []
            while at < len(rows) and rows[at][0] == indent and rows[at][1].startswith("-"):
                items.append(_scalar(rows[at][1][1:]))
                at += 1
            return items, at
        found: dict[str, Any] = {}
        while at < len(rows) and rows[at][0] == indent:
            key, colon, rest = rows[at][1].partition(":")
            if not colon:
                raise ValueError(f"no key in line: {rows[at][1]}")
            at += 1
            if rest.strip():
                found[_scalar(key)] = _scalar(rest)
            elif at < len(rows) and (rows[at][0] > indent or rows[at][0] == indent and rows[at][1].startswith("-")):
                found[_scalar(key)], at = block(at, rows[at][0])
            else:
                found[_scalar(key)] = None
        return found, at

    if not rows:
        return {}
    value, at = block(0, rows[0][0])
    if at < len(rows):
        raise ValueError(f"unexpected indentation: {rows[at][1]}")
    return value


def read(path: str | Path) -> dict:
    """A JSON or YAML file of rules."""
    text = Path(path).read_text(encoding="utf-8")
    return (json.loads(text) if str(path).endswith(".json") else parse_yaml(text)) or {}


def merge_deep(base: Any, over: Any) -> Any:
    """Mappings merge by key; anything else is replaced."""
    if not (isinstance(base, dict) and isinstance(over, dict)):
        return copy.deepcopy(over)
    return {x: merge_deep(base[x], over[x]) if x in base and x in over else copy.deepcopy(over.get(x, base.get(x))) for x in [*base, *(y for y in over if y not in base)]}


def load_rules(*paths: str | Path, profile: str | None = None) -> dict:
    """Defaults, then each file, then the profile. An unknown profile is a KeyError."""
    rules = copy.deepcopy(DEFAULTS)
    for p in paths:
        rules = merge_deep(rules, read(p))
    if profile:
        rules = merge_deep(rules, rules["scenario_profiles"][profile])
    return rules


def effective_suspect_domains(rules: dict, extra: list[str] | None = None) -> tuple[str, ...]:
    """Base, scenario and own domains in order, each once."""
    return tuple(dict.fromkeys([*rules.get("suspect_domains", ()), *rules.get("suspect_domains_extra", ()), *(extra or ())]))


def doc_minimum(rules: dict, doc_type: str) -> tuple[int, int] | None:
    found = rules.get("doc_minimums", {}).get(doc_type)
    return (found["min_sources"], found["min_chars"]) if found else None


def thresholds(rules: dict, mode: str) -> dict[str, tuple[int, int]]:
    """Least primary and independent sources by risk in a review mode, rounded up."""
    x = rules["review_modes"][mode]["evidence_multiplier"]
    return {r: (math.ceil(t["min_primary_sources"] * x), math.ceil(t["min_independent_sources"] * x)) for r, t in rules["evidence_sufficiency"].items()}
