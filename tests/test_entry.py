"""The entry points work without the subpackage llm, and every query with SQL has one."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_without_llm(tmp_path):
    ignored = shutil.ignore_patterns("llm", ".git", "__pycache__", "tests")
    for with_pipeline in (True, False):
        copy = tmp_path / str(with_pipeline)
        shutil.copytree(ROOT, copy, ignore=ignored)
        if not with_pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
