import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 7


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_alone(tmp_path):
    """Without the training-data operators the entry point still imports and has all other queries."""
    subprocess.run(["cp", "-r", ROOT / "plumbline", ROOT / "__spark_entry__.py", tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "plumbline/llm"], check=True)
    code = "import __spark_entry__ as e; from plumbline.queries import QUERIES; assert set(e.queries()) == set(QUERIES) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
