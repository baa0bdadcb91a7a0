"""Conversation structure repair by a rank-convergence parallel Viterbi search.

A conversation's rows are to be edited at least cost so that their roles read
``(system? (user assistant)+)?``.  States of that grammar are nothing yet, system, user
and assistant; the cost to go from a row on is one number a state, found from the last
row backwards.  Two such vectors that differ only by a constant lead to the same edits,
and after a few rows nearly all vectors do.

Rows are range-partitioned by conversation and turn, so a conversation of any length is
dealt over tasks; what a task holds of one is cut into segments of at most ``ROWS`` rows
or ``BYTES`` of text.  Conversations of one segment are solved where they lie.  Segments
of the others start from a speculative vector, that of a conversation's end.  A pass
over small rows, one a segment, stitches them from the end on: where the vector that
really comes in has not been tried (up to a constant), the conversation asks for it, and
a fix-up pass reruns its open segments from it, each until its vector differs only by a
constant from that of an earlier run.  There are few vectors up to constants
(:func:`vectors`), which bounds the passes, however long a conversation may be and even
where its rows never converge (as in rows of one role alone).

With the true vectors every segment traces its edits from each of the four states that
may enter it; the maps from entry to exit are stitched forwards, and each segment gives
out its own edits.  Only the digest of a whole conversation is made by one task, which
streams its segments: a SHA-256 can't be split.

Defined cases: a null role or text is one space; a null turn comes first; rows of one
turn stand in order of role and text; a null ``conv_id`` is a conversation of its own; an
empty role has no initial and is never kept; repeated rows are duplicates of each other
(equal rows of one turn lie in one task, which streams them); an empty table gives an
empty result; further columns are not read.  Rows with role and text seen earlier are
found by 96 bits of hash; n rows of a conversation mistake two with a chance of
n * n / 2^97.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.shared import staged

#: Largest segment, in rows and in characters of text.
ROWS, BYTES = 256, 1 << 18
#: Parts that conversations are dealt over; None leaves it to the size of the data.
PARTS: int | None = None
#: Costs of the edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = "\t\n\x0b\x0c\r "
#: States 0 to 3: nothing yet, after system, after user, after assistant.  What follows a
#: state by a role's initial; 4 is no state.
NEXT = {"s": (1, 4, 4, 4), "u": (2, 2, 4, 2), "a": (4, 4, 3, 4), "": (4, 4, 4, 4)}
#: What an inserted or new role leads to, and its name.
TURN, NAMES = (2, 2, 3, 2), ("user", "user", "assistant", "user")
FINE, CUT, GONE = range(3)
INITIALS = ("s", "u", "a", "")
#: The end of a conversation, inserts included: nothing yet and assistant may end.
END = (0, INSERT * 2, INSERT, 0)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with the faults that crc32 of ``conv_id:turn``
    modulo 20 picks, and a flag ``dropped`` in place of dropping rows."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    bare = blank("text")
    for c in ".!?":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    text = F.when(kind == 1, "").when(kind == 2, bare).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.explode(copies).alias("_")).drop("_")


def _step(after: tuple[int, ...], role: str, fault: int) -> tuple[int, ...]:
    """Costs to go before a row from those after it, inserts before the row included."""
    more = TRUNCATED if fault == CUT else 0
    costs = []
    for q in range(4):
        best = DELETE + after[q]
        if fault != GONE:
            best = min(best, REROLE + more + after[TURN[q]])
            if NEXT[role][q] < 4:
                best = min(best, more + after[NEXT[role][q]])
        costs.append(best)
    for _ in range(3):
        costs = [min(c, INSERT + costs[TURN[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


@cache
def step(after: int, code: int) -> tuple[int, int]:
    """(vector before a row of ``code``, the constant taken off it)."""
    costs = _step(unpacked(after), INITIALS[code & 3], code >> 2)
    return packed(costs), min(costs)


def packed(costs: tuple[int, ...]) -> int:
    """A vector up to a constant, as one number: differences never reach 16."""
    low = min(costs)
    return sum(c - low << 4 * q for q, c in enumerate(costs))


def unpacked(vector: int) -> tuple[int, ...]:
    return tuple(vector >> 4 * q & 15 for q in range(4))


def vectors() -> set[int]:
    """All vectors, up to constants, that can come before a row."""
    found, new = set(), {packed(END)}
    while new:
        found |= new
        new = {step(v, code)[0] for v in new for code in range(12)} - found
    return found


def search(codes: bytes, end: int, known: tuple[int, int, int] | None = None) -> tuple[int, int, int]:
    """(end, vector before the first row, constants taken off on the way).

    Beside a ``known`` run the search stops where both vectors differ only by a constant.
    """
    vector, cost = end, 0
    if known is None:
        for code in reversed(codes):
            vector, less = step(vector, code)
            cost += less
        return end, vector, cost
    other, spent = known[0], 0
    for code in reversed(codes):
        if vector == other:
            return end, known[1], cost + known[2] - spent
        vector, less = step(vector, code)
        other, fewer = step(other, code)
        cost, spent = cost + less, spent + fewer
    return end, vector, cost


def trace(codes: bytes, end: int, state: int, last: bool) -> tuple[str, int, int]:
    """(edits, exit state, cost): of the cheapest edits the ASCII-least, from ``state`` on."""
    togo = [unpacked(end)]
    for code in reversed(codes):
        togo.append(_step(togo[-1], INITIALS[code & 3], code >> 2))
    togo.reverse()
    out, spent = [], 0
    for i, code in enumerate(codes):
        role, fault = INITIALS[code & 3], code >> 2
        more = TRUNCATED if fault == CUT else 0
        here, after = togo[i], togo[i + 1]
        while True:
            if here[state] == DELETE + after[state]:
                out.append("D")
                spent += DELETE
            elif here[state] == INSERT + here[TURN[state]]:
                out.append("I")
                spent += INSERT
                state = TURN[state]
                continue
            elif fault != GONE and NEXT[role][state] < 4 and here[state] == more + after[NEXT[role][state]]:
                out.append("K")
                spent += more
                state = NEXT[role][state]
            else:
                out.append("R")
                spent += REROLE + more
                state = TURN[state]
            break
    while last and state in (1, 2):
        out.append("I")
        spent += INSERT
        state = TURN[state]
    return "".join(out), state, spent


def applied(audit: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The turns that the edits make of a segment's rows."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            out.append((NAMES[state], ""))
            state = TURN[state]
            continue
        if edit == "K":
            out.append((roles[at], texts[at]))
            state = NEXT[roles[at][:1]][state]
        elif edit == "R":
            out.append((NAMES[state], texts[at]))
            state = TURN[state]
        at += 1
    return out


def _again(rows: DataFrame) -> DataFrame:
    """``rows`` with ``again``: role and text stand in an earlier turn of the conversation."""
    keyed = rows.withColumns({"named": F.col("turn").isNotNull(), "h1": F.xxhash64("role", "text"), "h2": F.hash("role", "text")})
    said = keyed.where(~F.col("dropped") & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    firsts = said.groupBy("conv_id", "h1", "h2").agg(F.min(F.struct("named", "turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.struct("conv_id").alias("f"), F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first")
    met = keyed.join(firsts, F.struct("conv_id").eqNullSafe(F.col("f")) & (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
    return met.select("conv_id", "named", "turn", "role", "text", "dropped", F.coalesce(F.struct("named", "turn") > F.col("first"), F.lit(False)).alias("again"))


def _with_id(table: DataFrame, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", table.schema["conv_id"].dataType), *T.StructType.fromDDL(rest).fields])


def segments(turns: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """(conv_id, part, seq, open, codes, roles, texts, ...) in order of part and seq.

    ``open``: the conversation may have other segments.
    """
    schema = _with_id(turns, "part int, seq long, open boolean, codes binary, roles array<string>, texts array<string>, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        seq, now, first, out = 0, (), True, []
        codes, roles, texts, length = bytearray(), [], [], 0
        turns_, counts, before = [], [0, 0, 0, 0], None

        def close(more: bool):
            nonlocal seq, codes, roles, texts, length, turns_, counts
            met = [t for t in turns_ if t is not None]
            out.append((*now, part, seq, more, bytes(codes), roles, texts, met[0] if met else None, met[-1] if met else None, len(set(met)), *counts))
            seq += 1
            codes, roles, texts, length, turns_, counts = bytearray(), [], [], 0, [], [0, 0, 0, 0]

        def table():
            found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], names=arrow.names)
            out.clear()
            return found

        cut = False
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                columns = [batch.column(c).slice(at, 500).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "again")]
                for conv, turn, role, text, dropped, again in zip(*columns):
                    if now != (conv,):
                        if now:
                            close(first or cut)
                            first = False
                        now, before, cut = (conv,), None, False
                    if dropped:
                        continue
                    if codes and (len(codes) >= rows or length + len(text) > size):
                        close(True)
                        cut = True
                    bare = text.rstrip(BLANKS)
                    initial = role[:1]
                    if not bare:
                        fault, counts[0] = GONE, counts[0] + 1
                    elif again or before == (turn, role, text):
                        fault, counts[1] = GONE, counts[1] + 1
                    elif bare[-1] not in ".!?":
                        fault, counts[2] = CUT, counts[2] + 1
                    else:
                        fault = FINE
                    if codes:
                        counts[3] += roles[-1][:1] + initial not in ("su", "ua", "au")
                    codes.append(("sua".find(initial) if initial and initial in "sua" else 3) | fault << 2)
                    roles.append(role)
                    texts.append(text)
                    turns_.append(turn)
                    length += len(text)
                    before = (turn, role, text)
                if len(out) >= 64 or sum(map(len, (t for r in out[-8:] for t in r[6]))) > 8 * size:
                    yield table()
        if now:
            close(True)
        if out:
            yield table()

    ranged = _again(turns).repartitionByRange(*([PARTS] if PARTS else []), "conv_id", "named", "turn").sortWithinPartitions("conv_id", "named", "turn", "role", "text")
    return ranged.select("conv_id", "turn", "role", "text", "dropped", "again").mapInArrow(run, schema)


def _stream(table: DataFrame, order: list, columns: list[str], schema: str, each):
    """Rows of ``each(conversations' segments in order)``, one task a conversation.

    ``each`` takes an iterator of (same conversation as before, row) and yields rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = _with_id(table, schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now = ()
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    for row in zip(*(batch.column(c).slice(at, 64).to_pylist() for c in ("conv_id", *columns))):
                        yield now == row[:1], row
                        now = row[:1]

        out = []
        for row in each(rows()):
            out.append(row)
            if len(out) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], names=arrow.names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], names=arrow.names)

    if order:
        table = table.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    return table.select("conv_id", *columns).mapInArrow(run, parsed)


_RUN = "struct<ends:int,starts:int,cost:long>"


def _stitched(runs: DataFrame) -> DataFrame:
    """(conv_id, part, seq, ends, last, wanted): the vector after each segment of staged
    ``runs``; ``wanted`` where no run has started from it, in one row a conversation."""

    def each(rows):
        ends, stuck = packed(END), False
        for same, (conv, part, seq, tried) in rows:
            if not same:
                ends, stuck = packed(END), False
            if stuck:
                continue
            known = {r["ends"]: r["starts"] for r in tried}
            stuck = ends not in known
            yield conv, part, seq, ends, not same, stuck
            ends = known.get(ends)

    return _stream(runs, [F.desc("part"), F.desc("seq")], ["part", "seq", "tried"], "part int, seq long, ends int, last boolean, wanted boolean", each)


def _rerun(table: DataFrame) -> DataFrame:
    """``tried`` with a run from ``ends``, where that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tried = batch.column("tried").to_pylist()
            for i, (codes, ends) in enumerate(zip(batch.column("codes").to_pylist(), batch.column("ends").to_pylist())):
                if ends is not None and all(r["ends"] != ends for r in tried[i]):
                    known = tuple(tried[i][0].values()) if tried[i] else None
                    tried[i].append(dict(zip(("ends", "starts", "cost"), search(codes, ends, known))))
            kind = pa.list_(pa.struct([("ends", pa.int32()), ("starts", pa.int32()), ("cost", pa.int64())]))
            names = ["conv_id", "part", "seq", "codes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(tried, kind)], [*names, "tried"])

    kind = table.schema["conv_id"].dataType.simpleString()
    return table.select("conv_id", "part", "seq", "codes", "tried", "ends").mapInArrow(run, f"conv_id {kind}, part int, seq long, codes binary, tried array<{_RUN}>")


def solved(open_: DataFrame) -> DataFrame:
    """(part, seq, ends, last, entry) of staged segments(conv_id, part, seq, codes): the
    vector after each and the state before it."""
    runs = open_.withColumns({"tried": F.expr(f"cast(array() as array<{_RUN}>)"), "ends": F.lit(packed(END))})
    runs = staged(_rerun(runs), "viterbi-runs")
    while True:
        found = staged(_stitched(runs), "viterbi-stitched")
        wanted = found.where("wanted").select(F.struct("conv_id").alias("w"), F.struct("part", "seq").alias("at"), "ends")
        if not wanted.limit(1).count():
            break
        before = F.struct("conv_id").eqNullSafe(F.col("w")) & (F.struct("part", "seq") <= F.col("at"))
        runs = staged(_rerun(runs.join(wanted, before, "left")), "viterbi-runs")
    maps = runs.join(found.drop("conv_id", "wanted"), ["part", "seq"])

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "part", "seq", "ends", "last"]
        for batch in batches:
            out = [[trace(codes, ends, q, last)[1] for q in range(4)] for codes, ends, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "ends", "last")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.list_(pa.int32()))], [*names, "exits"])

    def each(rows):
        state = 0
        for same, (conv, part, seq, ends, last, out) in rows:
            state = state if same else 0
            yield conv, part, seq, ends, last, state
            state = out[state]

    kind = open_.schema["conv_id"].dataType.simpleString()
    mapped = maps.select("conv_id", "part", "seq", "codes", "ends", "last").mapInArrow(exits, f"conv_id {kind}, part int, seq long, ends int, last boolean, exits array<int>")
    return staged(_stream(mapped, ["part", "seq"], ["part", "seq", "ends", "last", "exits"], "part int, seq long, ends int, last boolean, entry int", each).drop("conv_id"), "viterbi-solved")


_COUNTS = ["low", "high", "distinct", "blank", "duplicate", "truncated", "illegal"]


def repaired(turns: DataFrame, rows: int = ROWS, size: int = BYTES) -> tuple[DataFrame, DataFrame]:
    """Repaired segments of ``turns(conv_id, turn, role, text, dropped)``: those of
    conversations of one segment, and all others.

    (conv_id, part, seq, audit, cost, turns array<struct<role, text>>, first, final (the
    initials of the first and last row before the repair) and the segment's counts).
    """
    cut = staged(segments(turns, rows, size), "turn-segments")
    found = solved(cut.where("open").select("conv_id", "part", "seq", "codes"))
    names = ["conv_id", "part", "seq", *_COUNTS]
    out = T.StructType([*(cut.schema[c] for c in names), *T.StructType.fromDDL("audit string, cost long, turns array<struct<role:string,text:string>>, first string, final string").fields])
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                batch = whole.slice(at, 16)
                audits, costs, made, first, final = [], [], [], [], []
                for codes, roles, texts, ends, last, entry in zip(*(batch.column(c).to_pylist() for c in ("codes", "roles", "texts", "ends", "last", "entry"))):
                    audit, _, cost = trace(codes, ends, entry, last)
                    audits.append(audit)
                    costs.append(cost)
                    made.append([{"role": r, "text": t} for r, t in applied(audit, entry, roles, texts)])
                    first.append(roles[0][:1] if roles else None)
                    final.append(roles[-1][:1] if roles else None)
                columns = [pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(made, kind), pa.array(first, pa.string()), pa.array(final, pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, "audit", "cost", "turns", "first", "final"])

    used = [*names, "codes", "roles", "texts", "ends", "last", "entry"]
    alone = cut.where("not open").withColumns({"ends": F.lit(packed(END)), "last": F.lit(True), "entry": F.lit(0)})
    shared = cut.where("open").join(found, ["part", "seq"])
    return tuple(x.select(*used).mapInArrow(run, out) for x in (alone, shared))


def digests(turns: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256."""

    def each(segments_):
        now = None
        for same, (conv, low, high, distinct, blank, duplicate, truncated, illegal, audit, cost, turns_, first, final) in segments_:
            if not same:
                if now:
                    yield closed(now)
                now = {"conv": conv, "low": None, "high": None, "distinct": 0, "counts": [0] * 5, "audit": [], "sha": hashlib.sha256(), "any": False, "final": None}
            if low is not None:
                now["distinct"] += distinct - (now["high"] == low)
                now["low"] = low if now["low"] is None else now["low"]
                now["high"] = high
            joint = now["final"] is not None and first is not None and now["final"] + first not in ("su", "ua", "au")
            now["counts"] = [a + b for a, b in zip(now["counts"], (blank, duplicate, truncated, illegal + joint, cost))]
            now["final"] = now["final"] if final is None else final
            now["audit"].append(audit)
            if turns_:
                text = "\n".join(f"{t['role']}:{t['text']}" for t in turns_)
                now["sha"].update(f"{chr(10) if now['any'] else ''}{text}".encode())
                now["any"] = True
        if now:
            yield closed(now)

    def closed(c):
        gaps = 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["distinct"]
        return c["conv"], gaps, *c["counts"], "".join(c["audit"]), c["sha"].hexdigest()

    out = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    columns = [*_COUNTS, "audit", "cost", "turns", "first", "final"]
    alone, shared = repaired(turns, rows, size)
    return _stream(alone, [], columns, out, each).unionByName(_stream(shared, ["part", "seq"], columns, out, each))
