"""The entry module: names, and that it works without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 30


def test_without_corpus_operators(tmp_path):
    import shutil

    for x in ("chunkloom", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / x).is_dir() else shutil.copy)(ROOT / x, tmp_path / x)
    shutil.rmtree(tmp_path / "chunkloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') and k[2:3].isdigit() for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
