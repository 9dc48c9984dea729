"""The entry module where the text part is missing."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

LISTS = """
import __spark_entry__ as driver
from crossbasket.plans.queries import registered
assert set(driver.queries()) == set(registered()) == set(driver.oracle_sql()), sorted(driver.queries())
print(len(driver.queries()))
"""


def test_entry_without_the_text_part(tmp_path):
    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copy(REPO / "__spark_entry__.py", copy)
    shutil.copytree(REPO / "crossbasket", copy / "crossbasket", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    done = subprocess.run([sys.executable, "-c", LISTS], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 86
    # the pipeline alone, without the package it needs, is left out as well
    if (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", copy)
        done = subprocess.run([sys.executable, "-c", LISTS], cwd=copy, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
