"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from markspan.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, copies_of string, state int"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
ROLES = re.compile(r"(s?(ua)+)?")


def after_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for conv, r in out.items()}


def cheapest(rows, must_go, cut):
    """(cost, audit, repaired rows) by a search in order of (cost, audit) over places and role initials so far."""
    n = len(rows)
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, shape, made = heapq.heappop(heap)
        if i == n and ROLES.fullmatch(shape):
            return cost, audit, made
        if (i, shape) in seen:
            continue
        seen.add((i, shape))
        options = [("I", 3, i, r, "") for r in ("user", "assistant")]
        if i < n:
            _, role, text = rows[i]
            options.append(("D", 4, i + 1, None, None))
            if not must_go[i]:
                options.append(("K", 3 * cut[i], i + 1, role, text))
                options += [("R", 3 + 3 * cut[i], i + 1, r, text) for r in ("user", "assistant")]
        for edit, price, j, role, text in options:
            grown = shape if role is None else shape + (role[:1] or "?")
            # a prefix of a wanted sequence, no longer than twice the rows
            if len(grown) <= 2 * n + 2 and (grown in ("", "s") or ROLES.fullmatch(grown) or ROLES.fullmatch(grown + "a")):
                heapq.heappush(heap, (cost + price, audit + edit, j, grown, made if role is None else (*made, (role, text))))
    raise AssertionError


def brute(rows):
    out = {}
    damaged = after_damage(rows)
    for conv in {r[0] for r in rows}:
        mine = damaged.get(conv, [])
        seen, faults = set(), []
        for _, role, text in mine:
            shown = BLANK.findall(text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, made = cheapest(mine, [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha)
    return out


def made_up(seed, conversations):
    r = random.Random(seed)
    texts = ["Hi.", "Hi.", "So?", "no end", "", "  \t", "Well! \n", "a.b", "é…", "long " * 500 + "."]
    rows = []
    for conv in range(conversations):
        for turn in range(r.randint(1, 9)):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]) if turn else r.choice(["system", "user", "assistant"])
            rows.append((conv, None if r.random() < 0.05 else turn * r.choice([1, 1, 2]), role, None if r.random() < 0.05 else r.choice(texts)))
    return rows


def test_reports_as_by_search(spark):
    rows = made_up(3, 150)
    rows += rows[::9] + [(None, 1, "user", "Hi."), (None, None, None, None), (7777, None, "user", "x.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = dialogue.repair_reports(dialogue.damaged(df))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = brute(rows)
    found = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert found == want
    assert got.count() == len(want)


def test_spilled_pointers_and_batches_give_the_same(spark):
    rows = made_up(4, 6) + [(100, t, r, x) for t, (r, x) in enumerate([("user", "Hi."), ("assistant", "So?"), ("user", "cut"), ("user", "Hi.")] * 700)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    whole = dialogue.repair_reports(dialogue.damaged(df)).collect()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        spilled = dialogue.repair_reports(dialogue.damaged(df), spill_bytes=64).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(map(repr, whole)) == sorted(map(repr, spilled))


def test_repaired_turns_have_the_reported_digest(spark):
    rows = made_up(8, 60)
    df = dialogue.damaged(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    reports = dialogue.repair_reports(df)
    texts = defaultdict(list)
    for r in dialogue.repaired_turns(df, reports).orderBy("conv_id", "place").collect():
        texts[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in reports.collect():
        assert hashlib.sha256("\n".join(texts[r["conv_id"]]).encode()).hexdigest() == r["repaired_sha256"]


def test_undamaged_rows_and_nothing(spark):
    good = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hi.")], "conv_id long, turn long, role string, text string")
    row = dialogue.repair_reports(good).first()
    assert (row["cost"], row["audit"], row["gaps"], row["illegal"]) == (0, "KKK", 0, 0)
    assert dialogue.repair_reports(good.filter(F.lit(False))).collect() == []
    dropped = dialogue.repair_reports(good.withColumn("copies", F.lit(0).cast("long"))).first()
    assert (dropped["cost"], dropped["audit"], dropped["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


def test_query_on_the_given_conversations(spark, small):
    from markspan.llm.queries import op13_dialogue

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in op13_dialogue(spark, small).collect()} == brute(rows)
