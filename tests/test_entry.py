"""The driver's contract: queries run, SQL names exist, the core needs no llm part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

REPO = Path(__file__).resolve().parents[1]


def test_contract(spark):
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60
    assert e.entry(spark).count() > 0


def test_core_imports_nothing_of_llm():
    for p in (REPO / "tagweave").rglob("*.py"):
        if "llm" not in p.relative_to(REPO / "tagweave").parts:
            assert "tagweave.llm" not in p.read_text(), p


def test_entry_without_llm(tmp_path):
    code = "import sys; sys.modules['tagweave.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p6_ids' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
