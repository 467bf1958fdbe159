"""Conversation repair against a plain dynamic programme over whole audits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from basketry.llm import turn_repair
from basketry.llm.queries import op12_turn_repair

TARGET = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2], said[3]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """One conversation's damaged rows -> the contract's columns."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    counts, live, seen = dict(blank=0, duplicate=0, truncated=0), [], set()
    for _, _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        cut = False
        if not shown:
            counts["blank"] += 1
        elif (role, text) in seen:
            counts["duplicate"] += 1
        elif shown[-1] not in ".!?":
            counts["truncated"] += 1
            cut = True
        live.append((bool(shown) and (role, text) not in seen, cut))
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]

    @lru_cache(None)
    def best(i, state, room):
        """(cost, audit, roles kept) from row i on; state: what the roles given so far are a prefix of."""
        found = []
        if i == len(rows):
            if TARGET.fullmatch(state):
                found.append((0, "", ()))
        else:
            ok, cut = live[i]
            found.append((2, "D", i + 1, state, ()))
            if ok:
                extra = 5 * cut
                found += [(extra, "K", i + 1, state + initials[i][:1], ((rows[i][2], rows[i][3]),))] if initials[i] else []
                found += [(1 + extra, "R", i + 1, state + role[0], ((role, rows[i][3]),)) for role in ("user", "assistant")]
        if room:
            found += [(5, "I", i, state + role[0], ((role, ""),)) for role in ("user", "assistant")]
        out = []
        for f in found:
            if len(f) == 3:
                out.append(f)
                continue
            cost, letter, j, after, kept = f
            if not any(TARGET.fullmatch(after + x) for x in ("", "a", "ua")):
                continue
            after = re.sub("^(s?)(ua)+", r"\1ua", after)
            rest = best(j, after, room - 1 if letter == "I" else 3)
            if rest:
                out.append((cost + rest[0], letter + rest[1], kept + rest[2]))
        return min(out, default=None)

    cost, audit, kept = best(0, "", 3)
    return dict(gaps=max(turns) - min(turns) + 1 - len(turns) if turns else 0, **counts,
                illegal=sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost=cost, audit=audit,
                repaired_sha256=hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def compare(got, rows):
    own = {}
    for r in rows:
        own.setdefault(r[0], [])
    for r in damage(rows):
        own[r[0]].append(r)
    got = {r.conv_id: r.asDict() for r in got}
    assert set(got) == set(own)
    for conv, mine in own.items():
        want = brute(mine)
        assert {k: got[conv][k] for k in want} == want, (conv, mine)


def odd_rows(seed, n, turns):
    random.seed(seed)
    texts = ["Yes.", "No", "Why?", "", " \n", "Well. ", "é!\n", "x", "end.\x85", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire", "User"]
    return [(random.choice([1, 2, 3, 4, 5, 6, 7, 8, None]), random.choice([*range(turns), None]), random.choice(roles[:random.choice([3, 10])]), random.choice(texts))
            for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_against_brute_force(spark, parts):
    rows = odd_rows(parts, 150, 9) + [(20, 1, "user", "a."), (30, t := None, None, None)] + [(40, 5, "user", "same.")] * 30
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'z' AS conv", "2 AS n")
    damaged = turn_repair.damaged(frame)
    compare(turn_repair.repair(damaged, parts).report().collect(), rows)


def test_one_long_conversation_over_many_parts(spark):
    random.seed(5)
    shapes = [("user", "assistant"), ("user", "user"), ("assistant", "assistant"), ("system", "user")]
    rows = [(1, t, random.choice(shapes[t // 40 % 4]), f"text {t // 2}" + "." * (t // 60 % 2)) for t in range(300)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for parts in (40, 150):
        compare(turn_repair.repair(turn_repair.damaged(frame), parts).report().collect(), rows)


def test_fix_up_stops_where_vectors_agree():
    steps, codes = turn_repair.Steps(), bytes([2, 3] * 500)
    first, ran = turn_repair.run_back(steps, codes, turn_repair.END)
    assert ran == 1000
    again, ran = turn_repair.run_back(steps, codes, bytes([3, 0, 5, 5]), first)
    assert ran < 20 and again == turn_repair.run_back(steps, codes, bytes([3, 0, 5, 5]))[0]


def test_given_table_rows_and_empty_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    report = op12_turn_repair(spark, "/root/testdata/sf0.001").collect()
    compare(report, rows)
    whole = turn_repair.repair(turn_repair.damaged(table)).rows().collect()
    for r in report:
        mine = sorted((x.position, x.role, x.text) for x in whole if x.conv_id == r.conv_id)
        assert [x[0] for x in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{x[1]}:{x[2]}" for x in mine).encode()).hexdigest() == r.repaired_sha256
    empty = turn_repair.repair(table.limit(0))
    assert empty.report().count() == 0 and empty.rows().count() == 0
