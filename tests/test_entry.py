import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import __spark_entry__
from oracle import rows_of_df, rows_of_sql
from vectide.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert SQL.keys() <= __spark_entry__.oracle_sql().keys() and QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.entry(spark).count() == 10


@pytest.mark.parametrize("name", ["vec_l2sq", "vec_normalize", "exact_knn_mips", "exact_knn_graph", "gt_audit", "imbalance", "centroid_mips", "kmeans_2rounds", "route_frequency", "ivf_search", "recall_by_probes", "attribution_variable", "pareto_front", "topmove_round", "spann_overlap"])
def test_as_sql(spark, name):
    assert rows_of_df(QUERIES[name](spark, SF)) == rows_of_sql(SQL[name], SF)
