"""Registered runs of the factor tables and curation jobs on the test graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphbi.plans import curation as C
from graphbi.plans import factors as FT
from graphbi.session import configure, scratch_path
from graphbi.sources.parquet import scan_parquet_temporal_window
from graphbi.sources.store import load_graph


def _factors(spark: SparkSession, sf_dir: str) -> C.Factors:
    configure(spark)
    return C.Factors(spark, load_graph(spark, sf_dir))


def _job(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(_factors(spark, sf_dir))
    return run


def _factor(fn, with_spark: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        g = load_graph(spark, sf_dir)
        return fn(spark, g) if with_spark else fn(g)
    return run


def temporal_window_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store the work-at lifetimes as parquet, then scan only the entities
    alive through the window (the filter is pushed to the parquet reader)."""
    configure(spark)
    path = scratch_path(spark, "temporal")
    FT.person_work_at_company_days(load_graph(spark, sf_dir)).write.parquet(path)
    return scan_parquet_temporal_window(spark, path, FT.WINDOW_START, FT.WINDOW_END)


QUERIES = {name: _job(fn) for name, fn in C.JOBS.items()}
QUERIES.update({
    "f_city_num_persons": _factor(FT.city_num_persons),
    "f_country_num_persons": _factor(FT.country_num_persons),
    "f_city_pairs_num_friends": _factor(FT.city_pairs_num_friends),
    "f_country_pairs_num_friends": _factor(FT.country_pairs_num_friends),
    "f_company_num_employees": _factor(FT.company_num_employees),
    "f_country_num_messages": _factor(FT.country_num_messages),
    "f_creation_day_num_messages": _factor(FT.creation_day_num_messages),
    "f_creation_day_length_category_num_messages": _factor(FT.creation_day_length_category_num_messages),
    "f_creation_day_tag_num_messages": _factor(FT.creation_day_tag_num_messages),
    "f_creation_day_tagclass_num_messages": _factor(FT.creation_day_tagclass_num_messages),
    "f_language_num_posts": _factor(FT.language_num_posts),
    "f_length_num_messages": _factor(FT.length_num_messages),
    "f_people_2_hops": _job(lambda f: f.people2Hops),
    "f_people_4_hops": _job(lambda f: f.people4Hops),
    "f_person_disjoint_employer_pairs": _job(lambda f: f.personDisjointEmployerPairs),
    "f_person_num_friends": _factor(FT.person_num_friends),
    "f_tagclass_num_messages": _factor(FT.tagclass_num_messages),
    "f_tagclass_num_tags": _factor(FT.tagclass_num_tags),
    "f_tag_num_messages": _factor(FT.tag_num_messages),
    "f_tag_num_persons": _factor(FT.tag_num_persons),
    "f_same_university_connected": _factor(FT.same_university_connected, with_spark=True),
    "f_person_days": _factor(FT.person_days),
    "f_person_knows_person_days": _factor(FT.person_knows_person_days),
    "f_person_study_at_university_days": _factor(FT.person_study_at_university_days),
    "f_person_work_at_company_days": _factor(FT.person_work_at_company_days),
    "scan_parquet_temporal_window": temporal_window_q,
})
