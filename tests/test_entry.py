"""The entry module with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_rest_imports_without_the_corpus_folders(tmp_path):
    for left_out in (("llm", "corpus_pipeline.py"), ("llm",)):
        copy = tmp_path / str(len(left_out))
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *left_out))
        assert not (copy / "tradewind" / "llm").exists()
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()))"], cwd=copy, capture_output=True, text=True)
        assert said.returncode == 0, said.stderr
        assert said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 150
