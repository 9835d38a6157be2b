"""The entry lives without its optional parts, and doesn't hide faults inside the library."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
print(len(e.queries()), any(n.startswith("op1_") for n in e.queries()), "pipeline" in e.queries())
"""


def without(name):
    return subprocess.run([sys.executable, "-c", BLOCK.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)


def test_missing_parts_are_left_out():
    for name in ("public_tokenizers", "xxhash", "kinetide.llm"):
        r = without(name)
        n, operators, pipeline = r.stdout.split()
        assert int(n) > 200 and operators == pipeline == "False" and "without kinetide.llm.queries" in r.stderr


def test_a_fault_in_the_library_is_raised():
    r = without("kinetide.kernels.attach")
    assert r.returncode and "ModuleNotFoundError" in r.stderr
