"""Conversation repair against a plain search for the cheapest edits."""

import hashlib
import random
import re
import sys
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from issue_signals.llm import conversation_repair as repair
from issue_signals.llm.queries import QUERIES

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).digest()


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))
    turns = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    roles = [r for _, r, _ in rows]
    illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    steps = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("3", "u"): "2", ("2", "a"): "3"}

    @cache
    def best(at, state, put):
        """(cost, audit, lines) to the end; put: inserts in this place so far."""
        found = [(0, "", ())] if at == len(rows) and state in "03" else []

        def then(cost, letter, role, text, to, state):
            if role is not None:
                state = steps.get((state, role[:1]))
            if state is not None:
                rest = best(to, state, put + 1 if to == at else 0)
                if rest is not None:
                    found.append((cost + rest[0], letter + rest[1], ((f"{role}:{text}",) if role is not None else ()) + rest[2]))

        if put < 3:
            for role in ("user", "assistant"):
                then(2, "I", role, "", at, state)
        if at < len(rows):
            _, role, text = rows[at]
            then(3, "D", None, None, at + 1, state)
            if faults[at] in ("", "truncated"):
                more = faults[at] == "truncated"
                then(more, "K", role, text, at + 1, state)
                for new in ("user", "assistant"):
                    then(2 + more, "R", new, text, at + 1, state)
        return min(found, key=lambda x: x[:2], default=None)

    cost, audit, lines = best(0, "0", 0)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines)).hex())


def plain(rows):
    return {(conv, *plain_repair(own)) for conv, own in plain_damage(rows).items()}


def strange_rows():
    r = random.Random(9)
    rows = []
    for conv in [None, *range(250)]:
        for turn in range(r.choice([0, 1, 2, 3, 5, 8, 12, 16]) or 1):
            said = r.choice([None, "", " \n", "Yes.", "No", "Well.\u0085", "ok!  ", f"t{r.randrange(3)}?", f"u{r.randrange(99)}", f"v{r.randrange(99)}."])
            row = (conv, r.choice([None, turn, turn, turn, turn + r.randrange(3)]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), said)
            rows += [row] * r.choice([1, 1, 1, 1, 3])
    return rows


@pytest.mark.parametrize("segment,rows_at_once", [(8_192, 32_768), (2, 5)])
def test_equals_a_plain_search(spark, monkeypatch, segment, rows_at_once):
    monkeypatch.setattr(repair, "ROWS", rows_at_once)
    rows = strange_rows()
    want = plain(rows)
    assert sum(x[6] > 0 for x in want) > 200 and any("I" in x[7] for x in want) and any("R" in x[7] for x in want)
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    said = said.withColumns({c: F.lit("x") for c in ("n", "kind", "digest", "segment", "order", "entry", "end", "c", "code")})
    got = repair.repaired(repair.damaged(said), segment).select(*COLUMNS).collect()
    assert len(got) == len(want) and {tuple(g) for g in got} == want


def test_a_long_conversation_and_an_empty_table(spark):
    r = random.Random(2)
    rows = [(7, k, r.choice(["user", "assistant", "assistant"]), r.choice(["same.", f"a{k}.", f"b{k}"])) for k in range(250)] + [(8, 0, "user", "x " * 500_000 + ".")]
    schema = "conv_id long, turn long, role string, text string"
    got = repair.repaired(repair.damaged(spark.createDataFrame(rows, schema)), 20).select(*COLUMNS)
    assert got.count() == 2
    sys.setrecursionlimit(20_000)
    assert {tuple(g) for g in got.collect()} == plain(rows)
    assert repair.repaired_conversations(spark.createDataFrame([], schema)).count() == 0


def test_query_equals_a_plain_search(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(g) for g in QUERIES["op11_conversation_repair"](spark, sf).select(*COLUMNS).collect()} == plain(rows)
