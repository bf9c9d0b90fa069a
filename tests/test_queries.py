import subprocess
import sys

import pytest

from kilnframe.plans import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, sf, same_rows, name):
    same_rows(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["label", "depth"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_operators(tmp_path):
    """The entry imports, and has the other queries, where the subpackage is gone."""
    import shutil
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "kilnframe", tmp_path / "kilnframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'affected_closure' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
