import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]
BLOCKED = """
import sys
class No:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("skeinwork.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, No())
import __spark_entry__ as e
names = set(e.queries())
assert "windows" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
assert set(e.oracle_sql()) <= names
"""


def test_the_entry_works_without_the_llm_subpackage():
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, check=True, timeout=120)


def test_a_missing_library_is_not_taken_for_a_missing_subpackage():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    found = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert found.returncode and "xxhash" in found.stderr


def test_nothing_outside_imports_the_llm_subpackage():
    for p in (ROOT / "skeinwork").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "skeinwork").parts:
            assert "skeinwork.llm" not in p.read_text(), p


def test_the_flagship_runs(spark):
    import __spark_entry__

    if Path("/root/testdata/sf0.001").is_dir():
        assert __spark_entry__.entry(spark).count() > 0
