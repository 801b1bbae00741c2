"""The entry module without a library that only the training-data operators use."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_other_queries_are_there_without_a_library():
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2:3].isdigit() for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, *rest = done.stdout.split()
    assert int(n) > 100 and rest == ["False", "False", "True"]
    if os.path.isdir(f"{ROOT}/optlattice/llm"):
        assert "without the training-data queries" in done.stderr and "tiktoken" in done.stderr
