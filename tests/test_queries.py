"""Every registered query of the library: equal to its SQL, or rows at all."""

import pytest

from sparkloom.plans import registry
from tests.conftest import SF
from verify import compare

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in SQL:
        assert compare(spark, duck, QUERIES[name], SQL[name], SF) == ""
    else:
        assert QUERIES[name](spark, SF).head(1)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["l_returnflag", "n", "mean", "std"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_library_module_imports_the_llm_subpackage():
    from pathlib import Path

    root = Path(registry.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "sparkloom.llm" not in p.read_text(), p
