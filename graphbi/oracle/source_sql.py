"""DuckDB oracle texts for the source/sink round trips."""

from __future__ import annotations

from graphbi.oracle.bi_sql import BI_SQL
from graphbi.oracle.curation_sql import CUR_SQL
from graphbi.oracle.fixture_sql import with_fixture

SOURCE_SQL = {
    "scan_csv_entity": with_fixture(select="select id, firstName, lastName, LocationCityId, creationDate from person"),
    "scan_csv_gz_multi": with_fixture(select="select creationDate, id, CreatorPersonId, ParentPostId, ParentCommentId, "
                                             "length, content, pk from comment_t"),
    "scan_csv_projected": with_fixture(select="select * from message_post"),
    "scan_batch_partition": with_fixture(select="select * from post where strftime(creationDate, '%Y-%m') = '2001-01'"),
    "scan_parameters": CUR_SQL["pg_08a"],
    "sink_parameters": ("select tag as \"tag:STRING\", cast(startDate as varchar) as \"startDate:DATE\", "
                        "cast(endDate as varchar) as \"endDate:DATE\" from (" + CUR_SQL["pg_08a"] + ")"),
    "sink_results": "select '2' query, '2a' variant, * from (" + BI_SQL["bi_02_tag_evolution"] + ")",
    "sink_table": with_fixture(select="select * from message"),
}
SOURCE_SQL["scan_parquet_factors"] = CUR_SQL["f_tag_num_messages"]
