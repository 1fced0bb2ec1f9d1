"""The driver's entry points with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print('NAMES', *q)"


def _names(folder):
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.rpartition("NAMES")[2].split()


@pytest.mark.parametrize("left", ["nothing", "pipeline", "empty folder"])
def test_works_without_training_data_operators(tmp_path, left):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    copy = tmp_path / "copy"
    for folder in ("loreweave/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    if left == "empty folder":
        (copy / "loreweave/llm/__pycache__").mkdir(parents=True)
    if left != "pipeline" and (copy / "corpus_pipeline.py").exists():
        (copy / "corpus_pipeline.py").unlink()
    names = _names(copy)
    assert "hybrid_search_documents" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")]


def test_a_broken_operator_is_not_hidden(tmp_path):
    if not (ROOT / "loreweave/llm").exists():
        pytest.skip("the training-data operators were taken out")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    (tmp_path / "copy/loreweave/llm/queries.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr


def test_every_query_is_listed_once():
    names = _names(ROOT)
    assert len(names) == len(set(names))
