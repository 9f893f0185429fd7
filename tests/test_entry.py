"""The driver's entry points, with the corpus part and without it."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_corpus_part(tmp_path):
    for name in ("ledgerline", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith("py") else None
    subprocess.run(["cp", "-r", str(ROOT / "ledgerline"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "ledgerline" / "llm")], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 50 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
