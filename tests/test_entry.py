import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_points_without_the_optional_parts(tmp_path):
    """A copy of the repository without them imports, and keeps its other queries."""
    code = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
assert len(e.queries()) > 40 and not any(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in e.queries())
"""
    copy = tmp_path / "copy"
    (copy / "streamledger").mkdir(parents=True)
    for path in ROOT.rglob("*.py"):
        part = path.relative_to(ROOT)
        if "llm" not in part.parts and part.parts[0] in ("streamledger", "__spark_entry__.py"):
            (copy / part).parent.mkdir(parents=True, exist_ok=True)
            (copy / part).write_text(path.read_text())
    subprocess.run([sys.executable, "-c", code, str(copy)], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})
