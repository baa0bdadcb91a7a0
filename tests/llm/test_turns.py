"""Conversation repair against a search over whole conversations, edit by edit."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.llm import turn_repair
from larkspur.llm.queries import QUERIES

SCHEMA = "conv_id long, turn int, role string, text string, part int, seq long, open boolean, last boolean"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def best(rows):
    """(cost, audit, turns): the cheapest edits of (role, text, fault), ties ASCII-least."""
    after = {None: {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    later = None
    for i in range(len(rows), -1, -1):
        here = {q: (0, "", ()) for q in (None, "a")} if i == len(rows) else {}
        if i < len(rows):
            role, text, fault = rows[i]
            more = 3 if fault == "truncated" else 0
            for q in after:
                found = [(4 + later[q][0], "D" + later[q][1], later[q][2])]
                if fault not in ("blank", "duplicate"):
                    if (to := after[q].get(role[:1])) is not None:
                        found.append((more + later[to][0], "K" + later[to][1], ((role, text), *later[to][2])))
                    found += [(3 + more + later[t][0], "R" + later[t][1], ((names[t], text), *later[t][2])) for t in after[q] if t in names]
                here[q] = min(found, key=lambda f: f[:2])
        for _ in range(4):  # inserts before row i
            for q in after:
                for t in after[q]:
                    if t in names and t in here:
                        one = (3 + here[t][0], "I" + here[t][1], ((names[t], ""), *here[t][2]))
                        here[q] = min(here.get(q, one), one, key=lambda f: f[:2])
        later = here
    return later[None]


def brute(given):
    convs = defaultdict(list)
    for conv, turn, role, text in given:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = convs[conv]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows.extend([(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = []
    for conv, rows in convs.items():
        rows.sort()
        seen, faults = set(), []
        for _, _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "fine" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for named, t, *_ in rows if named}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, made = best([(r[2], r[3], f) for r, f in zip(rows, faults)])
        text = "\n".join(f"{r}:{t}" for r, t in made)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def answer(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answer(QUERIES["op13_turn_repair"](spark, sf)) == brute(given)


def _made(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(30)]:
        for turn in range(rng.choice([0, 1, 2, 3, 8, 40])):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "aside"])
            text = rng.choice([None, "", " \n", "Fine.", "Is it?", f"no {turn}.", f"cut {turn}", f"{turn}! \t", "é" * 30, "x" * 4000 + "."])
            rows += [(conv, rng.choice([turn, turn, 2 * turn, None]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("seed,rows,size", [(1, 256, 1 << 18), (2, 3, 1 << 18), (3, 1, 50)])
def test_defined_cases(spark, seed, rows, size):
    given = _made(seed)
    df = spark.createDataFrame([(*r, 1, 2, True, None) for r in given], SCHEMA).repartition(3)
    assert answer(turn_repair.digests(turn_repair.damaged(df), rows, size)) == brute(given)


@pytest.mark.parametrize("role", ["user", "system", "mixed", "blank"])
def test_one_long_conversation(spark, monkeypatch, role):
    """Rows that never converge, in one conversation over several tasks, among short ones."""
    rng = random.Random(5)
    names = {"mixed": ["user", "assistant", "user", "system"], "blank": ["user"]}.get(role, [role])
    given = [(7, i, rng.choice(names), "" if role == "blank" and i % 900 > 2 else f"said {i}.") for i in range(2000)]
    given += [(i, t, "user" if t % 2 == 0 else "assistant", f"{i} {t}.") for i in range(5, 12) if i != 7 for t in range(4)]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in given], SCHEMA).repartition(4)
    monkeypatch.setattr(turn_repair, "PARTS", 4)
    cut = turn_repair.staged(turn_repair.segments(turn_repair.damaged(df), 40), "t")
    long = cut.where("conv_id = 7")
    assert long.select("part").distinct().count() > 1 and long.count() > 40 and cut.where("not open").count()
    assert answer(turn_repair.digests(turn_repair.damaged(df), 40)) == brute(given)


def test_passes_are_bounded_by_the_vectors():
    found = turn_repair.vectors()
    assert len(found) < 40 and max(max(turn_repair.unpacked(v)) for v in found) < 16
    codes = bytes(random.Random(1).choices(range(12), k=400))
    for end in found:
        known = turn_repair.search(codes, turn_repair.packed(turn_repair.END))
        assert turn_repair.search(codes, end, known) == turn_repair.search(codes, end)


def test_empty_and_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.digests(turn_repair.damaged(empty)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "x", None, None, None, None)], SCHEMA)
    assert answer(turn_repair.digests(turn_repair.damaged(one))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns_are_given_out(spark):
    df = spark.createDataFrame([(i, t, "user", f"a {t}.", None, None, None, None) for i in range(20) for t in range(5)], SCHEMA)
    alone, shared = turn_repair.repaired(turn_repair.damaged(df))
    made = alone.unionByName(shared).select("conv_id", "part", "seq", F.explode("turns").alias("t")).orderBy("conv_id", "part", "seq").collect()
    assert {r.t.role for r in made} == {"user", "assistant"}
