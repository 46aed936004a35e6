"""The core without the training-data folders and without the pipeline's file."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_points_without_the_training_data_folders(tmp_path):
    left_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=left_out)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sel_box' in q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op') or n == 'pipeline']"
    # A pipeline file that is left behind on its own must not be imported either.
    for kept in ([], ["corpus_pipeline.py"]):
        for name in kept:
            shutil.copy(ROOT / name, tmp_path / "repo") if (ROOT / name).exists() else None
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_training_data_folder():
    for path in (ROOT / "ndgrid").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "ndgrid.llm" not in path.read_text(), path
