"""The driver's contract, also without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["file_name", "name", "value", "unit", "period_end", "context_ref", "display"] and df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_subpackage(tmp_path):
    """A copy of the repository that lacks sedimenta/llm and corpus_pipeline.py still imports."""
    import shutil

    shutil.copytree(REPO / "sedimenta", tmp_path / "sedimenta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
