"""Result formats as string columns, and conversation exports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_field(value: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line break."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(value.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def xml_text(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def csv_lines(results: DataFrame) -> DataFrame:
    """results(docid, score, path, title, context) with ``line``; scores have 4 places."""
    cells = [F.concat(F.lit("#"), "docid"), F.format_string("%.4f", "score"), csv_field(F.col("path")), csv_field(F.col("title")), csv_field(F.col("context"))]
    return results.withColumn("line", F.concat_ws(",", *cells))


def json_lines(results: DataFrame) -> DataFrame:
    """One JSON object a result, scores of 2 places, no key for a null context."""
    return results.withColumn("line", F.to_json(F.struct(F.concat(F.lit("#"), "docid").alias("docid"), F.round("score", 2).alias("score"), F.col("path").alias("file"), "title", "context")))


def xml_lines(results: DataFrame) -> DataFrame:
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), xml_text(c), F.lit('"'))
    context = F.when(F.col("context").isNull(), "").otherwise(attribute("context", F.col("context")))
    return results.withColumn("line", F.concat(F.lit("<file"), attribute("docid", F.concat(F.lit("#"), "docid")), attribute("name", F.col("path")), attribute("title", F.col("title")), context, F.lit("/>")))


_MESSAGE = "struct<role:string,sender:string,content:string,text:string,message:string>"
_CHAT = f"struct<chat_messages:array<{_MESSAGE}>>"
_TREE = "struct<mapping:map<string,struct<message:struct<author:struct<role:string>,content:struct<parts:array<string>>>>>>"


def conversations(files: DataFrame) -> DataFrame:
    """(file, turn, role, text) of conversation exports files(file, raw).

    Lists or single objects with a ``mapping`` tree of messages, or with
    ``chat_messages``; lists of messages with role and content; lines of JSON; plain text
    in paragraphs of 20 characters.  The role is ``assistant`` or else ``user``; texts
    of JSON need 10 characters, those of trees one more.
    """
    raw = F.trim("raw")
    has = lambda path: F.get_json_object(raw, path).isNotNull()
    rows = F.split(raw, "\n", 2)  # a first line that is JSON by itself, and more: lines of JSON
    json = F.try_parse_json(raw).isNotNull() & ~((F.size(rows) > 1) & F.try_parse_json(rows[0]).isNotNull())
    kind = (
        F.when(json & raw.startswith("[") & has("$[0].mapping"), "trees")
        .when(json & raw.startswith("[") & has("$[0].uuid"), "chats")
        .when(json & raw.startswith("[") & has("$[0].role") & has("$[0].content"), "messages")
        .when(json & raw.startswith("{") & has("$.mapping"), "tree")
        .when(json & raw.startswith("{") & has("$.chat_messages"), "chat")
        .when(~json & raw.startswith("{"), "lines")
        .otherwise("plain")
    )
    df = files.select("file", raw.alias("raw"), kind.alias("kind"))

    def turns(messages: Column, role, text, least: int) -> Column:
        made = F.transform(messages, lambda m: F.struct(F.when(role(m) == "assistant", "assistant").otherwise("user").alias("role"), text(m).alias("text")))
        return F.filter(made, lambda t: F.length(t["text"]) >= least)

    trees = F.when(F.col("kind") == "tree", F.array(F.from_json("raw", _TREE))).otherwise(F.from_json("raw", f"array<{_TREE}>"))
    nodes = F.flatten(F.transform(F.filter(trees, lambda t: t["mapping"].isNotNull()), lambda t: F.map_values(t["mapping"])))
    tree = turns(nodes, lambda m: m["message"]["author"]["role"], lambda m: F.trim(F.array_join(m["message"]["content"]["parts"], "\n")), 11)
    chats = F.when(F.col("kind") == "chat", F.array(F.from_json("raw", _CHAT))).otherwise(F.from_json("raw", f"array<{_CHAT}>"))
    sent = F.flatten(F.transform(F.filter(chats, lambda c: c["chat_messages"].isNotNull()), lambda c: c["chat_messages"]))
    chat = turns(sent, lambda m: m["sender"], lambda m: m["text"], 10)
    messages = turns(F.from_json("raw", f"array<{_MESSAGE}>"), lambda m: m["role"], lambda m: m["content"], 10)
    said = lambda m: F.coalesce(F.nullif(m["content"], F.lit("")), F.nullif(m["text"], F.lit("")), m["message"])
    lines = turns(F.transform(F.filter(F.split("raw", "\n"), lambda x: F.trim(x).startswith("{")), lambda x: F.from_json(x, _MESSAGE)), lambda m: m["role"], said, 10)
    paragraphs = F.filter(F.transform(F.split("raw", r"\n{2,}"), lambda x: F.struct(F.lit("user").alias("role"), F.trim(x).alias("text"))), lambda t: F.length(t["text"]) >= 20)
    found = F.when(F.col("kind").isin("trees", "tree"), tree).when(F.col("kind").isin("chats", "chat"), chat).when(F.col("kind") == "messages", messages).when(F.col("kind") == "lines", lines).otherwise(paragraphs)
    return df.select("file", F.posexplode(found).alias("turn", "m")).select("file", "turn", "m.role", "m.text")


def markdown_lines(results: DataFrame) -> DataFrame:
    """A heading a result, with its id, path and context."""
    context = F.when(F.col("context").isNull(), "").otherwise(F.concat(F.lit("\n**context:** "), "context"))
    return results.withColumn("line", F.concat(F.lit("# "), "title", F.lit("\n**docid:** `#"), "docid", F.lit("`\n**file:** "), "path", context))
