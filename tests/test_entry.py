"""The driver's contract, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["day", "bid", "re", "im"] and df.count() == 500
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_stands_alone(tmp_path):
    """Without the llm folders and the pipeline the entry module imports and has the other queries."""
    for name in ("farside", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "farside/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'vis_forward' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
