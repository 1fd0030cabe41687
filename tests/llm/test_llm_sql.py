import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from oracle import rows_of_df, rows_of_sql
from vectide.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_as_sql(spark, name):
    assert rows_of_df(queries.queries()[name](spark, SF)) == rows_of_sql(queries.oracle_sql()[name], SF)


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
