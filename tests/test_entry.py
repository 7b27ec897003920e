"""The entry without the optional corpus operators."""

import subprocess
import sys

CODE = """
import sys
class Away:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("fleetlens.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Away())
import __spark_entry__ as e
assert "language_counts" in e.queries() and "language_counts" in e.oracle_sql()
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in e.queries())
"""


def test_entry_without_corpus_operators():
    subprocess.run([sys.executable, "-c", CODE], check=True, timeout=120)


def test_nothing_else_imports_them():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for file in [*(root / "fleetlens").rglob("*.py"), root / "bench.py"]:
        if "llm" not in file.relative_to(root).parts:
            assert "fleetlens.llm" not in file.read_text(), file
