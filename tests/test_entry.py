"""The driver entry with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(n.startswith('op') or n == 'pipeline' for n in q))"


def names(cwd, before=""):
    return subprocess.run([sys.executable, "-c", before + SHOW], cwd=cwd, env=os.environ | {"PYTHONPATH": cwd}, capture_output=True, text=True, check=True).stdout.split()


def test_without_a_library_of_the_corpus_operators():
    n, sql, corpus = names(ROOT, "import sys; sys.modules['xxhash'] = None; ")
    assert int(n) > 100 and int(sql) > 90 and corpus == "False"


def test_without_the_corpus_operators(tmp_path):
    at = str(tmp_path / "repo")
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    assert names(at)[2] == "False" and names(at)[0] == names(ROOT, "import sys; sys.modules['sidera.llm'] = None; ")[0]
