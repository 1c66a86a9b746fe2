"""The entry points work without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "_shared"))
    code = "import __spark_entry__ as e; assert 'o_g09_components' in e.queries() and not any(k.startswith('op') for k in e.queries()); print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "potamos")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "potamos.llm" not in open(os.path.join(folder, f)).read()
