"""DuckDB oracle texts for the validation and scoring jobs."""

from __future__ import annotations

from graphbi.oracle.fixture_sql import with_fixture
from graphbi.plans.scoring import POWER_VARIANTS, THROUGHPUT_MIN_TIME

_POWER = ", ".join(f"'{q}'" for q in POWER_VARIANTS)


def _at(p: float) -> str:
    """The discrete percentile of the sorted times ``ts``."""
    return f"ts[greatest(1, ceil({p} * len(ts))::integer)]"


_CTES = [
    ("sorted_times", "select tool, q, list_sort(list(time)) ts from timings where batch_type = 'power' group by tool, q"),
    ("pstats", "select tool, coalesce(try_cast(regexp_extract(q, '[0-9]+') as integer), 0) qid, q, len(ts)::bigint count, "
               "ts[1] min_time, ts[-1] max_time, round(list_avg(ts), 6) avg_time, round(list_sum(ts), 6) total_time, "
               + ", ".join(f"{_at(p / 100)} p{p}_time" for p in (50, 90, 95, 99)) + " from sorted_times"),
    ("sfs", "select tool, any_value(sf) sf from timings group by tool"),
    ("days", "select tool, day, sum(time) took, count(*) runs from timings where batch_type = 'throughput' "
             "and q in ('reads', 'writes') group by tool, day"),
    # a day counts if the days before it take less than the hour that all days together reach
    ("counted", "select tool, took, runs from (select *, coalesce(sum(took) over (partition by tool order by day rows "
                "between unbounded preceding and 1 preceding), 0) earlier, sum(took) over (partition by tool) whole from days) "
                f"where earlier < {THROUGHPUT_MIN_TIME} and whole >= {THROUGHPUT_MIN_TIME}"),
    ("tb", "select tool, coalesce(sum(runs), 0)::bigint // 2 n_batches, round(sum(took), 6) t_batches "
           "from sfs left join counted using (tool) group by tool"),
]

SCORE_SQL = {
    "score_power_stats": with_fixture(*_CTES, select="select * from pstats"),
    "score_throughput_batches": with_fixture(*_CTES, select="select * from tb"),
    "score_power": with_fixture(*_CTES, select=(
        "select p.tool, round(p.power, 6) power, round(p.power * s.sf, 6) power_at_sf from (select tool, "
        f"3600 / geometric_mean(total_time) power from pstats where q in ({_POWER}) group by tool) p "
        "join sfs s on s.tool = p.tool")),
    "score_throughput": with_fixture(*_CTES, select=(
        "select tool, round(rate, 6) throughput, round(rate * sf, 6) throughput_at_sf from sfs join (select tool, "
        "(86400 - 600.0) * nullif(n_batches, 0) / t_batches rate from tb) using (tool)")),
    "validate_results": with_fixture(
        ("d1", "select cast(creationDate as date) d, count(*) f, avg(length) a from message group by 1"),
        ("d2", "select d, sum(n) f, sum(s) / sum(n) a from (select cast(creationDate as date) d, count(*) n, "
               "sum(length) s from message group by 1, case when length < 40 then 0 when length < 80 then 1 "
               "when length < 160 then 2 else 3 end) group by d"),
        ("inst", "select year(coalesce(d1.d, d2.d))::varchar params, max(case when d1.d is null or d2.d is null "
                 "or abs(d1.f - d2.f) > 0.00001 or abs(d1.a - d2.a) > 0.00001 then 1 else 0 end) failed, "
                 "count(d1.d) > 0 e, count(d2.d) > 0 a from d1 full join d2 on d1.d = d2.d group by 1"),
        select="select 'creationDay' variant, count(*) instances, count(*) filter (e and not a) skipped, "
               "count(*) filter (e <> a) misaligned, count(*) filter (e and a and failed = 1) failed, "
               "count(*) filter (e and a and failed = 1) = 0 passed from inst"),
}
