import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", ["corpus_pipeline", "heliograph.llm"])
def test_stands_without_the_subpackage(gone):
    code = f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_other_missing_modules_are_errors():
    code = "import sys; sys.modules['heliograph.operators.fusion'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True).returncode != 0
