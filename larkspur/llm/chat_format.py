"""Chat formatting by schema fingerprints.

A record's nested field paths, sorted and hashed, are its fingerprint; it selects a
declarative mapping that says where turns, roles and texts lie, so prompt/response,
instruction and message layouts all become canonical turns (conversation, position,
role, text).  Paths that no mapping knows are left out of the fingerprint, so extra
fields don't matter.

The template marks turns with control strings; inside texts and roles a backslash is
doubled and a control string gets a backslash after its first character, so the
formatted text holds no control string but the template's own, and taking the
backslashes away restores every text.  Formatted conversations are stored as segments
of ``SEGMENT`` turns with their loss spans, so no task holds a whole long conversation.

Defined cases: null role and text are empty; turns that share a number are ordered by
role and text, and all kept; a null turn comes first; null ids make one conversation;
a record whose fingerprint is unknown gives no turn and is listed by ``unmapped``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed strings of the template, and others that common chat templates give meaning.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROL = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
SEGMENT = 256


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``turns`` is the path of a list (or "" for fixed fields); ``role`` and ``text`` are
    field names inside it.  With fixed fields, ``fields`` lists (role, field names whose
    texts are joined by a blank line).
    """

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


MAPPINGS = (
    Mapping("rows", ("conv_id", "role", "text", "turn"), role="role", text="text"),
    Mapping("messages", ("messages[].content", "messages[].role"), "messages", "role", "content"),
    Mapping("shares", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Mapping("prompt", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("completion", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction-input", ("input", "instruction", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system-instruction", ("instruction", "output", "system"), fields=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
)
KNOWN = frozenset(p for m in MAPPINGS for p in m.paths)


def fingerprint(paths) -> str:
    """Hash of the known paths among ``paths``."""
    return hashlib.sha256("\n".join(sorted(KNOWN.intersection(paths))).encode()).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def value_paths(value, at: str = "") -> set[str]:
    """Nested paths of the leaves of a parsed record; lists add ``[]``."""
    if isinstance(value, dict):
        return set().union(*(value_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(value_paths(v, at + "[]") for v in value))
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested paths of the leaves of a Spark type."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return {at}


def _turns(record) -> list[tuple[str, str]] | None:
    mapping = BY_FINGERPRINT.get(fingerprint(value_paths(record)))
    if mapping is None or not isinstance(record, dict):
        return None
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if mapping.turns:
        return [(text(m.get(mapping.role)), text(m.get(mapping.text))) for m in record[mapping.turns]]
    return [(role, "\n\n".join(filter(None, (text(record.get(f)) for f in names)))) for role, names in mapping.fields]


def turns_of_json(records: DataFrame, key: str, column: str) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of records held as JSON strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, raw in zip(batch.column("conv_id").to_pylist(), batch.column("raw").to_pylist()):
                try:
                    found = _turns(json.loads(raw or "null"))
                except ValueError:
                    found = None
                rows += [(conv, i, r, t) for i, (r, t) in enumerate(found or ())]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.column("conv_id").type, pa.int64(), pa.string(), pa.string()))], ["conv_id", "turn", "role", "text"])

    kind = records.schema[key].dataType.simpleString()
    return records.select(F.col(key).alias("conv_id"), F.col(column).alias("raw")).mapInArrow(run, f"conv_id {kind}, turn long, role string, text string")


def turns_of_table(table: DataFrame) -> DataFrame:
    """Canonical turns of a table; its schema's fingerprint selects the mapping.

    Layouts with fixed fields or a list of turns need an id column ``conv_id``.
    """
    mapping = BY_FINGERPRINT.get(fingerprint(schema_paths(table.schema)))
    if mapping is None and "conv_id" in table.columns:
        mapping = BY_FINGERPRINT.get(fingerprint(schema_paths(table.drop("conv_id").schema)))
    if mapping is None:
        raise ValueError(f"no mapping for the fields {sorted(schema_paths(table.schema))}")
    if mapping.turns:
        rows = table.select("conv_id", F.posexplode(mapping.turns).alias("turn", "_m"))
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col(f"_m.{mapping.role}").alias("role"), F.col(f"_m.{mapping.text}").alias("text"))
    if mapping.fields:
        parts = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[F.col(n).cast("string") for n in names]), lambda x: x != ""), "\n\n").alias("text")) for role, names in mapping.fields]
        rows = table.select("conv_id", F.posexplode(F.array(*parts)).alias("turn", "_m"))
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "_m.role", "_m.text")
    return table.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col(mapping.role).alias("role"), F.col(mapping.text).alias("text"))


def unmapped(records: DataFrame, key: str, column: str) -> DataFrame:
    """(key, fingerprint) of the JSON records that no mapping fits."""

    @F.udf("string")
    def odd(raw):
        try:
            found = fingerprint(value_paths(json.loads(raw or "null")))
        except ValueError:
            return "not JSON"
        return None if found in BY_FINGERPRINT else found

    return records.select(F.col(key), odd(F.col(column)).alias("fingerprint")).where("fingerprint is not null")


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, segment, formatted, loss): segments in order make the conversation.

    ``loss`` lists [start, stop) spans of code points in the segment: the texts of the
    ``trained`` roles.  Segments hold the turns of ``SEGMENT`` successive numbers; where
    a number repeats they part again by a hash, so none grows without bound.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.floor(F.col("turn") / SEGMENT).alias("piece"))
    spread = rows.groupBy("conv_id", "turn").count().where(F.col("count") > SEGMENT)
    if spread.limit(1).count():  # numbers that repeat: order their rows by a range sort
        rows = _split_repeats(rows)
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    mark = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY))
    rows = rows.select("conv_id", "piece", "part", "turn", "role", "text", mark.alias("head"), escaped(F.col("text")).alias("body"))
    one = F.struct("turn", "role", "text", F.concat("head", "body", F.lit(END)).alias("out"), F.length("head").alias("skip"), F.length("body").alias("size"))
    segments = rows.groupBy("conv_id", "piece", "part").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["out"])).alias("at"),
            F.when(t["role"].isin(*trained), F.concat(s["spans"], F.array(F.struct((s["at"] + t["skip"]).alias("start"), (s["at"] + t["skip"] + t["size"]).alias("stop"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    segment = F.struct(F.coalesce("piece", F.lit(-(1 << 62))).alias("piece"), F.col("part"))
    return segments.select("conv_id", segment.alias("segment"), F.array_join(F.transform("turns", lambda t: t["out"]), "").alias("formatted"), spans.alias("loss"))


def _split_repeats(rows: DataFrame) -> DataFrame:
    """``part``: the number of a turn's run of rows, in (role, text) order.

    Rows are range-partitioned by everything that orders them; a run is what a
    partition holds of a turn, cut every ``SEGMENT`` rows.  All turns of a conversation
    with a repeated one have pieces of their own, so that its segments sort by turn.
    """
    from larkspur.llm.shared import staged

    ranged = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    ranged = staged(ranged.withColumn("_task", F.spark_partition_id()).withColumn("_no", F.monotonically_increasing_id()), "turn-order")
    counts = ranged.groupBy("conv_id", "turn").count().where(F.col("count") > SEGMENT).select("conv_id").distinct()
    many = counts.select(F.struct("conv_id").alias("_k"), F.lit(1).alias("_many"))
    marked = ranged.join(many, F.struct(ranged["conv_id"]).eqNullSafe(F.col("_k")), "left")
    low = Window.partitionBy("conv_id", "turn", "_task")
    first = F.min("_no").over(low)
    part = F.when(F.col("_many").isNull(), F.lit(-1)).otherwise(F.col("_task").cast("long") * (1 << 40) + F.floor((F.col("_no") - first) / SEGMENT))
    return marked.withColumn("part", part).withColumn("piece", F.when(F.col("_many").isNull(), F.col("piece") * SEGMENT).otherwise(F.col("turn"))).drop("_task", "_no", "_k", "_many")


_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}", re.S)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from its formatted segments: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    A task streams the segments of a conversation in order; it holds one at a time.
    """
    out = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = ["conv_id", *(c.split()[0] for c in out.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object, None
        rows: list[tuple] = []

        def close():
            if state:
                rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                for m in _TURN.finditer(text):
                    if m.start() != at:
                        raise ValueError("text outside the turns of a formatted conversation")
                    at = m.end()
                    state[0] += 1
                    state[1].update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode())
                for span in loss:
                    trained = unescaped(text[span["start"] : span["stop"]])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                state[4] += len(text)
            kind = batch.column("conv_id").type
            if rows:
                yield _digests(rows, kind, names)
                rows = []
        close()
        if rows:
            yield _digests(rows, kind, names)

    kind = segments.schema["conv_id"].dataType.simpleString()
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment").select("conv_id", "formatted", "loss").mapInArrow(run, f"conv_id {kind}, {out}")


def _digests(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
