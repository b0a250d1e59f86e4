"""The driver's entry point, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q)"


def entry(folder):
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()


def test_entry_stands_without_the_training_data_operators(folder):
    for name in ("citeline", "checks"):
        shutil.copytree(REPO / name, f"{folder}/{name}", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", folder)
    Path(f"{folder}/citeline/llm/__pycache__").mkdir(parents=True)  # what may be left of it
    count, pipeline = entry(folder)
    assert int(count) > 80 and pipeline == "False"


def test_entry_does_not_hide_a_broken_operator(folder):
    for name in ("citeline", "checks"):
        shutil.copytree(REPO / name, f"{folder}/{name}", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(REPO / "__spark_entry__.py", folder)
    Path(f"{folder}/citeline/llm").mkdir()
    Path(f"{folder}/citeline/llm/__init__.py").write_text("")
    Path(f"{folder}/citeline/llm/queries.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr
