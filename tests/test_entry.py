import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_runs_without_the_llm_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for part in root.rglob("*.py"):
        at = part.relative_to(root)
        if "llm" not in at.parts and at.name != "corpus_pipeline.py" and at.parts[0] != "tests":
            (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / at).write_text(part.read_text())
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; n = e.queries(); print(len(n)); assert 'icir' in n and 'op1_bpe' not in n; e.oracle_sql()"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
