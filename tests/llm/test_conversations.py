"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from shelfscope.llm import conversations as C
from shelfscope.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, conv string, absent string, first long, hash string"
sys.setrecursionlimit(20_000)   # the plain search goes one call deeper per row
WHITE = " \t\n\x0b\x0c\r"


def plain(rows):
    """Report of one conversation's rows (turn, role, text), by search over edit strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        core = text.strip(WHITE)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else
                      "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, made, room):
        """Least (cost, letters) after row i, with the role initials so far."""
        found = []
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            found.append((0, ""))
        if room:
            for r in "ua":
                if legal(made + r):
                    c, a = best(i, keep(made + r), room - 1)
                    found.append((c + 2, "I" + a))
        if i < len(rows):
            more = int(faults[i] == "truncated")
            c, a = best(i + 1, made, 3)
            found.append((c + 3, "D" + a))
            if faults[i] in ("", "truncated"):
                for r in "ua":
                    if legal(made + r):
                        c, a = best(i + 1, keep(made + r), 3)
                        found.append((c + 2 + more, "R" + a))
                if rows[i][1] and legal(made + rows[i][1][0]):
                    c, a = best(i + 1, keep(made + rows[i][1][0]), 3)
                    found.append((c + more, "K" + a))
        return min(found, default=(1 << 20, ""))

    def legal(made):
        return re.fullmatch("s?(ua)*u?", made) is not None

    def keep(made):    # what comes later depends on the start and the last letter only
        return made if len(made) < 4 else "ua" + made[-(1 + (made[-1] == "a")):] if made[-1] == "a" else "uau"

    cost, audit = best(0, "", 3)
    out, made, at = [], "", 0
    for letter in audit:
        if letter == "I":
            role, text = ("assistant" if made.endswith("u") else "user"), ""
        else:
            _, role, text = rows[at]
            at += 1
            if letter == "D":
                continue
            if letter == "R":
                role = "assistant" if made.endswith("u") else "user"
        made += role[0]
        out.append(f"{role}:{text}")
    turns = [r[0] for r in rows if r[0] is not None]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def damage(rows):
    """{conv_id: rows after damage}, in plain Python."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        held = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def odd_rows():
    rng = random.Random(13)
    rows = []
    for conv in range(400):
        for turn in range(rng.randint(0, 9)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            if rng.random() < 0.7:
                role = ("user", "assistant")[turn % 2]
            text = rng.choice(["Hi.", "Hi", "so it is!", "ok? \n", "é", " \t", "", None, f"word {rng.random()}.", "a.b"])
            rows.append((conv if conv != 7 else None, turn if rng.random() < 0.95 else None, role, text))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    rows += [(1000, t, "tool", f"{t}") for t in range(300)]                      # chains that never meet
    rows += [(1001, t, ("user", "assistant")[t % 2], "x" * 20_000 + str(t)) for t in range(30)]
    rows += [(1002, 5, "user", "same.")] * 40 + [(1002, 5, "assistant", "other.")]
    rows += [(1003, t, "system", f"{t}.") for t in range(6)] + [(1004, None, None, None)]
    rows += [(1005, -5, "user", "a."), (1005, 1 << 60, "assistant", "b.")]
    return [(*r, "c", "x", 1, "h") for r in rows]


@pytest.mark.parametrize("spill", [C.SPILL, 600])
def test_report_equals_plain_search(spark, spill):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")     # conversations cross batches
    try:
        got = C.report(queries.damaged(df), absent=F.col("gone"), spill=spill).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {conv: plain(tuple(r)) for conv, r in damage(rows).items()}
    assert {r["conv_id"] for r in got} == set(expected) and len(got) == len(expected)
    for r in got:
        assert {k: r[k] for k in expected[r["conv_id"]]} == expected[r["conv_id"]], r["conv_id"]


def test_repaired_rows_are_legal_and_carry_the_digest(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    by = {}
    for r in C.repaired(df).collect():
        by.setdefault(r["conv_id"], []).append(r)
    reports = {r["conv_id"]: r for r in C.report(df).collect()}
    assert set(by) == set(reports)
    for conv, rows in by.items():
        rows.sort(key=lambda r: r["position"])
        left = [r for r in rows if r["edit"] != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in left))
        assert "".join(r["edit"] for r in rows) == reports[conv]["audit"]
        digest = hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in left).encode()).hexdigest()
        assert digest == reports[conv]["repaired_sha256"]
        assert all(r["edit"] == "D" for r in rows if r["fault"] in ("blank", "duplicate"))


def test_gone_conversations_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a.", "", "", 0, ""), (2, 1, "user", "a.", "", "", 0, "")], SCHEMA)
    got = {r["conv_id"]: r for r in C.report(rows, absent=F.col("conv_id") == 2).collect()}
    assert got[1]["audit"] == "KI" and got[1]["cost"] == 2
    assert (got[2]["audit"], got[2]["cost"], got[2]["gaps"]) == ("", 0, 0)
    assert got[2]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    none = rows.limit(0)
    assert C.report(none).collect() == [] and C.repaired(none).collect() == []
    assert C.report(rows.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))).select("conv_id").distinct().count() == 2
