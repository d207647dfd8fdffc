from __future__ import annotations

import os
import shutil
import subprocess
import sys

from conftest import HERE

ASK = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
print(len(q), sorted(k for k in q if k.startswith("op") and k[2].isdigit()), "pipeline" in q, set(o) <= set(q))
"""


def _ask(top) -> str:
    env = os.environ | {"PYTHONPATH": str(top), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", ASK], cwd=top, env=env, capture_output=True, text=True, check=True).stdout.strip()


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    """With the corpus operators' folders removed, and also with the pipeline's file, all other queries stay."""
    for name in ("folioworks", "__spark_entry__.py", "corpus_pipeline.py"):
        of = os.path.join(HERE, name)
        if os.path.isdir(of):
            shutil.copytree(of, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(of):
            shutil.copy(of, tmp_path / name)
    (n, without) = (x := _ask(tmp_path))[: x.index(" ")], x[x.index(" ") :]
    assert int(n) > 100 and without == " [] False True"
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _ask(tmp_path) == x
