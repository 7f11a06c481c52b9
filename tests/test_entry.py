"""The entry module must import before any session exists."""

import subprocess
import sys
from pathlib import Path


def test_imports_without_a_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=Path(__file__).resolve().parent.parent, check=True)
