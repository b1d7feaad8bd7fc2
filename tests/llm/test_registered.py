import __spark_entry__ as entry
from cohort.llm import queries


def test_all_thirteen_operators_are_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(queries.QUERIES)
