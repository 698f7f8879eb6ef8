import subprocess, sys
from pathlib import Path
R = Path(__file__).parents[2]


def test_import_errors_surface():
    code = "import sys; sys.modules['corpusmill.llm.tokens'] = None; import __spark_entry__"
    got = subprocess.run([sys.executable, "-c", code], cwd=R, capture_output=True, text=True)
    assert got.returncode and "corpusmill.llm" in got.stderr


def test_queries_are_registered():
    sys.path.insert(0, str(R))
    import __spark_entry__ as e
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 9)} | {"p7_ids", "p8_packed"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
