"""The library without its corpus part."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry_without_corpus_part(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "tempora", tmp_path / "tempora", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'asof_join' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=False)
    assert run.returncode == 0, run.stderr


def test_nothing_else_imports_the_corpus_part():
    for f in (ROOT / "tempora").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "tempora.llm" not in f.read_text(), f
