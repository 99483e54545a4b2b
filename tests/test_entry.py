import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import pytest


def test_every_query_has_a_plan_and_oracles_have_queries(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["identifier", "id_type", "domains"]


def test_entry_without_the_training_data_part(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        out = importlib.reload(e)
        assert "owner_clusters" in out.queries() and not any(q.startswith("op") for q in out.queries())
    except ModuleNotFoundError:  # a blocked module names itself
        pytest.fail("the guard let an absent pipeline through")
    finally:
        monkeypatch.undo()
        importlib.reload(e)


def test_entry_with_the_training_data_part_deleted(tmp_path):
    """A copy of the repository without that part still imports, with all other queries and their SQL."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 130 and set(q) == set(e.oracle_sql()) and not [k for k in q if k.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)


def test_entry_without_the_public_vocabularies():
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert 'owner_clusters' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
