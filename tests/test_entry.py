"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_subpackage():
    code = (
        "import sys\nclass Gone:\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('cardloom.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nq = e.queries()\nassert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
