"""A refresh computes the tables that are read, each once."""

from graphbi.plans import refresh as R


def test_a_table_is_computed_once_and_when_it_is_read_first(spark):
    made = []
    tables = R.Tables({"a": spark.range(1)})
    tables.later("b", lambda: (made.append("b"), spark.range(2))[1])
    copy = R.Tables(tables)
    changed = copy.each(lambda t, df: df.withColumn("t", df["id"] + 1))
    assert list(changed) == ["a", "b"] and made == []
    assert changed["b"].count() == copy["b"].count() == tables["b"].count() == 2 and made == ["b"]


def test_inserting_persons_and_deleting_them_reads_no_message(spark):
    def unread():
        raise AssertionError("read")

    person = "id bigint, name string"
    edges = {"person_likes_message": ("MessageId",), "person_workat": ("CompanyId",), "person_studyat": ("UniversityId",),
             "person_hasinterest": ("TagId",), "forum_hasmember": ("ForumId",)}
    tables, ins = R.Tables(), R.Tables()
    for rows, of in (([(1, "a"), (2, "b")], tables), ([(2, "c"), (3, "d")], ins)):
        of["person"] = spark.createDataFrame(rows, person)
        of["person_knows_person"] = spark.createDataFrame([(1, 2)], "Person1Id bigint, Person2Id bigint")
        of["forum"] = spark.createDataFrame([(5, "Group x", 1)], "id bigint, title string, ModeratorPersonId bigint")
        for t, (other,) in edges.items():
            of[t] = spark.createDataFrame([(1, 7)], f"PersonId bigint, {other} bigint")
        for t in ("post", "comment", "post_hastag", "comment_hastag", "message", "message_hastag"):
            of.later(t, unread)
    after = R.apply_inserts(spark, tables, ins)
    assert sorted(map(tuple, after["person"].collect())) == [(1, "a"), (2, "b"), (3, "d")]
    out, _ = R.delete_person(after, spark.createDataFrame([(1,)], "id bigint"))
    assert {t: out[t].count() for t in ("person", "person_knows_person", "person_likes_message", "forum_hasmember")} == {
        "person": 2, "person_knows_person": 0, "person_likes_message": 0, "forum_hasmember": 0}
    assert out["forum"].first()["ModeratorPersonId"] is None
