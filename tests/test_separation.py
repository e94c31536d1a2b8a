"""The library works where the training-data subpackage, its tests and the pipeline have been removed, together or in part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and not [n for n in {**q, **o} if n.startswith('op') or n == 'pipeline'], sorted(q)"


def environment():
    """The copy stands for the repository; whatever else PYTHONPATH names (packages may lie there) stays."""
    others = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(ROOT)]
    return os.environ | {"PYTHONPATH": os.pathsep.join(others)}


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_subpackage(tmp_path, pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    env = environment()
    assert not (copy / "hemaspark" / "llm").exists() and not (copy / "tests" / "llm").exists()
    for command in (["-c", PROBE], ["-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"]):
        done = subprocess.run([sys.executable, *command], cwd=copy, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stdout + done.stderr


def test_what_is_left_of_a_removed_folder_is_no_package(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    (copy / "hemaspark" / "llm" / "__pycache__").mkdir(parents=True)
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env=environment(), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
