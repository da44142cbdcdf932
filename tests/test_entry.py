import re
import subprocess
import sys

from .conftest import ROOT

ALONE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("keyflow.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "mget_orders" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_the_corpus_operators():
    subprocess.run([sys.executable, "-c", ALONE], cwd=ROOT, check=True)


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_imports_the_corpus_operators():
    for file in (ROOT / "keyflow").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert not re.search(r"import.*\bllm\b|from .*\bllm\b", file.read_text()), file
