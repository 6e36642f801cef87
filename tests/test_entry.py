import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_names_are_known_without_a_session():
    """Queries and SQL can be listed before Spark starts, and every SQL belongs to a query."""
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q); print('fine')"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True).stdout.strip() == "fine"


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"category", "average", "quotes"}


def test_library_does_not_import_the_llm_subpackage():
    files = [p for p in (ROOT / "quotelake").rglob("*.py") if p.parent.name != "llm"]
    assert not [p for p in files if "quotelake.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]


def test_every_sql_is_text():
    import __spark_entry__

    assert all(isinstance(x, str) for x in __spark_entry__.oracle_sql().values())
