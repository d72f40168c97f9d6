"""Conversation repair against a search over all edit sequences."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from graphbi.llm import conversation_repair as C

ROWS = "conv_id bigint, turn bigint, role string, text string, cost bigint, gone string"
LETTER = {"user": "u", "assistant": "a"}


def plain_damage(rows):
    """{conv_id: rows left}, by the contract's words."""
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        said = lambda x: " " if x is None else str(x)
        what = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        left = out[conv]
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        left += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        real = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not real else "duplicate" if (role, text) in seen else "truncated" if real[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """(cost, audit, lines) of the best of all edit sequences that cost no more than deleting every row."""
    best = (2 * len(rows), "D" * len(rows), [])

    def go(i, cost, audit, lines):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join((x[0] or " ")[:1] for x in lines)):
            best = min(best, (cost, audit, lines))
        for role in LETTER:
            go(i, cost + 5, audit + "I", [*lines, (role, "")])
        if i < len(rows):
            _, role, text = rows[i]
            go(i + 1, cost + 2, audit + "D", lines)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                go(i + 1, cost + more, audit + "K", [*lines, (role, text)])
                for other in LETTER:
                    go(i + 1, cost + more + 1, audit + "R", [*lines, (other, text)])

    go(0, 0, "", [])
    return best


def plain(rows):
    out = {}
    for conv, left in plain_damage(rows).items():
        faults, turns = plain_faults(left), {t for t, *_ in left if t is not None}
        pairs = [(a[1] or " ")[0] + (b[1] or " ")[0] for a, b in zip(left, left[1:], strict=False)]
        cost, audit, lines = plain_repair(left, faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def awkward():
    rng, rows = random.Random(11), []
    for conv in range(150):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant"][turn % 2:] + ["system", "user", "assistant"]) if rng.random() < 0.9 else rng.choice([None, "", "tool", "Ünknown"])
            text = rng.choice(["Yes.", "No!", "cut off", "Why? ", "fine.\n", "  ", "", None, "Yes.", "é ünd 漢."])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), role, text, 1, "x"))
    rows += [(None, t, r, "Ok.", None, None) for t, r in ((1, "user"), (2, "assistant"), (2, "assistant"), (None, "user"))]
    rows += [(900 + i, 0, "user", "Only one.", 1, "x") for i in range(40)]  # some lose their only row
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(awkward(), ROWS).repartition(4)


def test_report(rows):
    want = plain(awkward())
    out = C.report(C.damage(rows))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    assert got == want
    empty = hashlib.sha256(b"").hexdigest()
    assert any(v == (0, 0, 0, 0, 0, 0, "", empty) for c, v in got.items() if c is not None and c >= 900)
    assert {r.conv_id: tuple(r)[1:] for r in C.report(C.damage(rows), spill=1).collect()} == want  # a block for every row
    assert C.report(C.damage(rows.limit(0))).count() == 0


def test_repaired_turns(rows):
    digests = {c: v[-1] for c, v in plain(awkward()).items()}
    lines = defaultdict(list)
    for r in sorted(C.repaired(C.damage(rows)).collect(), key=lambda r: r.position):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() for c in digests} == digests


def test_giant_conversation(spark):
    """One conversation that takes several blocks: nothing but its alternation is left to repair."""
    n = 30000
    one = spark.range(n).selectExpr("7 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text ', id, '.') as text")
    whole = C.report(one, spill=1 << 16).first()
    assert (whole.audit, whole.cost, whole.gaps, whole.duplicate) == ("K" * n, 0, 0, 0)
    want = hashlib.sha256("\n".join(f"{('user', 'assistant')[i % 2]}:text {i}." for i in range(n)).encode()).hexdigest()
    assert whole.repaired_sha256 == want
    holes = C.report(one.where("turn <> 10001"), spill=1 << 16).first()
    assert (holes.cost, holes.gaps, holes.illegal) == (2, 1, 1) and holes.audit.count("D") == 1


def test_one_shuffle_and_query(spark, rows):
    plan = C.report(C.damage(rows))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    want = plain([tuple(r) for r in table.collect()])
    assert {r.conv_id: tuple(r)[1:] for r in C.op11_conversation_repair(spark, sf).collect()} == want
