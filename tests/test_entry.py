import importlib
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_sql_agree():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 80


def test_core_never_imports_the_llm_subpackage():
    code = "import sys, citeloom.plans.registry, citeloom.operators.retrieval, citeloom.streaming.calls, citeloom.sources.files; assert not any(m.startswith('citeloom.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_has_rows(spark, data):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).count() > 0
