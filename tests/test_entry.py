"""The driver's entry works without the subpackage and the pipeline that may be removed."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_parts(tmp_path):
    shutil.copytree(f"{ROOT}/tessera", tmp_path / "tessera", ignore=lambda folder, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n == 'pipeline' or n.startswith('op')])"
    for optional in (False, True):  # the pipeline's file may stay behind
        if optional and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
            shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
        out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split(maxsplit=2)
        assert int(out[0]) > 100 and int(out[1]) > 100 and out[2].strip() == "[]"
