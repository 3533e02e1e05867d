"""The entry module without the subpackage for training text, and with one that is broken inside."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
"""


def copied(to, leave_out):
    """The repository's code in another folder, but for some paths."""
    skip = lambda folder, names: [n for n in names if n in (".git", "__pycache__", "tests") or os.path.relpath(os.path.join(folder, n), ROOT) in leave_out]
    shutil.copytree(ROOT, to, ignore=skip)
    return to


def ran(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("gone", [["watchplan/llm", "corpus_pipeline.py"], ["watchplan/llm"], ["corpus_pipeline.py"]])
def test_entry_without_llm(tmp_path, gone):
    folder = copied(tmp_path / "repo", gone)
    done = ran(folder, CODE)
    assert done.returncode == 0, done.stderr
    if "watchplan/llm" in gone:  # an empty folder that was left behind is no package
        os.makedirs(folder / "watchplan/llm/__pycache__")
        assert ran(folder, CODE).returncode == 0


def test_a_broken_subpackage_is_an_error(tmp_path):
    if not os.path.isdir(os.path.join(ROOT, "watchplan/llm")):
        pytest.skip("the subpackage is absent")
    done = ran(copied(tmp_path / "repo", ["watchplan/llm/bpe.py"]), CODE)
    assert done.returncode and "bpe" in done.stderr


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "watchplan")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert "watchplan.llm" not in f.read(), name
