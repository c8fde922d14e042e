"""Every registered query against its SQL at the smallest scale."""

import pytest

from catalog import CASES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, c in CASES.items() if c.sql])
def test_query(spark, db, name):
    assert difference(CASES[name].run(spark, SF), db, CASES[name].sql) is None


def test_plans_hold_no_python_and_no_nested_loops(spark):
    for name, case in CASES.items():
        if name[0] in "MSX" or name.startswith(("N12_r", "E1")):
            continue
        plan = case.run(spark, SF)._jdf.queryExecution().executedPlan().toString()
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython",
                     "BatchEvalPython", "PythonUDF"):
            assert word not in plan, (name, word)
