"""Query 17 against nested loops, with a forum that holds a third of the messages."""

import datetime as dt
import random

import pytest

from graphbi.plans.bi import bi_17_information_propagation


@pytest.mark.parametrize("seed", [1, 2])
def test_propagation(spark, seed):
    rng = random.Random(seed)
    people, forums = range(12), range(6)
    message = []
    for i in range(160):
        parent = rng.choice(message) if message and rng.random() < 0.6 else None
        forum = parent[3] if parent else 0 if rng.random() < 0.33 else rng.choice(forums)
        day = dt.datetime(2010, 1, 1) + dt.timedelta(hours=rng.randrange(60))
        message.append((i, day, rng.choice(people), forum, parent[0] if parent else None))
    member = {(f, p) for f in forums for p in people if rng.random() < 0.4}
    tagged = [(m[0], 1) for m in message if rng.random() < 0.9]
    g = {"message": spark.createDataFrame(message, "MessageId bigint, creationDate timestamp_ntz, CreatorPersonId bigint, ContainerForumId bigint, ParentMessageId bigint"),
         "forum_hasmember": spark.createDataFrame(sorted(member), "ForumId bigint, PersonId bigint"),
         "message_hastag": spark.createDataFrame(tagged, "MessageId bigint, TagId bigint"),
         "tag": spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, name string")}
    mine = [m for m in message if (m[0], 1) in set(tagged)]
    found = {}
    for _, day1, p1, f1, _ in mine:
        for id2, day2, p3, f2, _ in mine:
            if f1 != f2 and day1 + dt.timedelta(hours=4) < day2 and (f2, p1) not in member and (f1, p3) in member:
                if any(c[4] == id2 and c[2] != p3 and (f1, c[2]) in member for c in mine):
                    found.setdefault(p1, set()).add(id2)
    want = sorted(((p, len(ids)) for p, ids in found.items()), key=lambda x: (-x[1], x[0]))[:10]
    assert want
    assert [tuple(r) for r in bi_17_information_propagation(g, "x", 4).collect()] == want
