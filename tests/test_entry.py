"""The entry module without the optional subpackage or one of its libraries."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class Blocker:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"no {{name}}", name=name)
sys.meta_path.insert(0, Blocker())
import __spark_entry__ as entry
assert set(entry.oracle_sql()) <= set(entry.queries())
print(len(entry.queries()), any(name.startswith("op") for name in entry.queries()))
"""


def entry_without(name):
    code = BLOCK.format(name=name)
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("name", ["pricemill.llm", "corpus_pipeline", "public_tokenizers", "xxhash"])
def test_entry_lives_without(name):
    out = entry_without(name)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 40


def test_other_missing_modules_are_faults():
    assert entry_without("pricemill.operators.groups").returncode != 0
