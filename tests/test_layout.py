"""The library and the driver's entry stand without the training-data operators."""

import ast
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') for k in e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_operators(tmp_path, pipeline):
    shutil.copytree(ROOT / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists() and (pipeline or name != "corpus_pipeline.py"):
            shutil.copy(ROOT / name, tmp_path)
    said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 50 and said[1:3] == ["0", "False"] and int(said[3]) > 50


def test_nothing_else_imports_them():
    for path in (ROOT / "quern").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("quern.llm") for n in names), path
