import re
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def listed(folder):
    code = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout


def test_stands_without_the_corpus_operators(tmp_path):
    """With their folder gone, and with the pipeline gone too, the other queries are listed; with both there, all are."""
    shutil.copytree(REPO / "spurline", tmp_path / "spurline", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    alone = listed(tmp_path)
    assert "score_pipeline" in alone and "op1_" not in alone
    if (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
        assert listed(tmp_path) == alone
    if (REPO / "spurline" / "llm").exists():
        whole = listed(REPO)
        assert set(re.findall("'([^']+)'", alone)) < set(re.findall("'([^']+)'", whole)) and "'pipeline'" in whole
