"""The entry gives its own queries whatever of the training-data part can be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = """
import builtins, sys
real = builtins.__import__
def without(name, *args, **kwargs):
    if name.split(".")[0] in {blocked!r} or name in {blocked!r}:
        raise ModuleNotFoundError(name, name=name)
    return real(name, *args, **kwargs)
builtins.__import__ = without
import __spark_entry__ as e
own = [q for q in e.queries() if q != "pipeline" and not q.startswith("op")]
print(len(own), len(e.queries()) - len(own))
"""


@pytest.mark.parametrize("blocked", [["xxhash", "zstandard"], ["deckloom.llm"], ["corpus_pipeline"]])
def test_queries_without(blocked):
    run = subprocess.run([sys.executable, "-c", COUNT.replace("{blocked!r}", repr(blocked))], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-500:]
    assert int(run.stdout.split()[0]) >= 107
