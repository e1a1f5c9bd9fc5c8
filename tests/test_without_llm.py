"""The rest of the library imports and registers its queries when the llm folders are gone."""

import os
import shutil
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_rest_stands_alone():
    folder = tempfile.mkdtemp(prefix="spark-")
    shutil.copytree(f"{ROOT}/lektra", f"{folder}/lektra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", folder)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q); print('fine')"], cwd=folder, capture_output=True, text=True)
    assert said.stdout.strip().endswith("fine"), said.stderr
