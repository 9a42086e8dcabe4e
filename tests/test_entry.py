"""The driver's module without the subpackage for training text, and without a library that it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("absent", ["corpus_pipeline", "cellwright.llm", "xxhash"])
def test_other_queries_stay(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(said[0]) >= 50 and int(said[1]) >= 50 and said[2] == "False"
