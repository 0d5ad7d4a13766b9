"""The rest of the library without the training-data package, and a session without settings."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def _copy(to, *without):
    shutil.copytree(ROOT, to, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or str(pathlib.Path(folder, n).relative_to(ROOT)) in without])


def _python(at, code, *args):
    return subprocess.run([sys.executable, *(["-c", code] if code else args)], cwd=at, capture_output=True, text=True, timeout=300)


def test_rest_works_without_the_training_data_package(tmp_path):
    at = tmp_path / "copy"
    _copy(at, "lodemap/llm", "tests/llm")
    said = _python(at, "import __spark_entry__ as e, bench; print(len(e.queries()), len(e.oracle_sql()), [q for q in e.queries() if q.startswith('op')])")
    assert said.returncode == 0, said.stderr
    assert "[]" in said.stdout and int(said.stdout.split()[0]) > 70
    collected = _python(at, None, "-m", "pytest", "tests", "--collect-only", "-q")
    assert collected.returncode == 0, collected.stdout + collected.stderr
    bare = tmp_path / "bare"
    _copy(bare, "lodemap/llm", "tests/llm", "corpus_pipeline.py")
    assert _python(bare, "import __spark_entry__ as e; e.queries(), e.oracle_sql()").returncode == 0


def test_written_tables_in_a_session_without_a_checkpoint_folder(tmp_path):
    code = f"""
from lodemap import local_session
from lodemap.scratch import Scratch
spark = local_session(1, shuffle_partitions=1, memory='1g')
with Scratch(spark, 'x') as scratch:
    assert scratch.table(spark.range(3), 't').count() == 3
    made = scratch.path('t')
print(spark._jvm.org.apache.hadoop.fs.Path(made).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(made)))
"""
    said = _python(ROOT, code)
    assert said.returncode == 0, said.stderr
    assert said.stdout.strip().endswith("false") or said.stdout.strip().endswith("False")
