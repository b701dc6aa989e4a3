"""The entry lists the core queries whatever else is there."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
LISTED = """
import importlib.abc, sys
class Blocked(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in sys.argv[1].split(",") or name in sys.argv[1].split(","):
            raise ImportError(name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
from attesta import queries as core
q, o = e.queries(), e.oracle_sql()
assert core.queries().keys() <= q.keys() and set(core.oracle_sql()) <= set(o) <= set(q)
print(sum(x.startswith("op") and x[2].isdigit() for x in q), "pipeline" in q)
"""


def listed(blocked: str) -> str:
    return subprocess.run([sys.executable, "-c", LISTED, blocked], cwd=ROOT, capture_output=True, text=True, check=True).stdout.strip()


def test_core_queries_without_a_library():
    """A library or folder that is missing takes the queries with it that need it, and no others."""
    assert listed("xxhash") == listed("attesta.llm") == "0 False"
    assert listed("corpus_pipeline").endswith("False")
