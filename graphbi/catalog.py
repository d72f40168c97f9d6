"""Registry of every operator as (spark, sf_dir) -> DataFrame, and its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphbi.oracle.bi_sql import BI_SQL
from graphbi.oracle.curation_sql import CUR_SQL
from graphbi.oracle.operator_sql import OP_SQL
from graphbi.oracle.refresh_sql import REFRESH_SQL
from graphbi.oracle.scoring_sql import SCORE_SQL
from graphbi.oracle.source_sql import SOURCE_SQL
from graphbi.oracle.workload_sql import WORKLOAD_SQL
from graphbi.plans import bi, curation_queries, operator_queries, refresh_queries, scoring_queries, source_queries, workload_queries
from graphbi.session import configure
from graphbi.sources.store import load_graph

Query = Callable[[SparkSession, str], DataFrame]


def _bi(name: str) -> Query:
    fn = bi.QUERIES[name]
    params = bi.DEFAULTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(load_graph(spark, sf_dir), **params)

    run.__name__ = name
    return run


QUERIES: dict[str, Query] = {name: _bi(name) for name in bi.QUERIES}
QUERIES.update(operator_queries.QUERIES)
QUERIES.update(curation_queries.QUERIES)
QUERIES.update(scoring_queries.QUERIES)
QUERIES.update(refresh_queries.QUERIES)
QUERIES.update(source_queries.QUERIES)
QUERIES.update(workload_queries.QUERIES)
ORACLE_SQL: dict[str, str] = {**BI_SQL, **OP_SQL, **CUR_SQL, **SCORE_SQL, **REFRESH_SQL, **SOURCE_SQL, **WORKLOAD_SQL}
