"""Tool-call linking for chat transcripts, with DataFrame functions only.

Calls and results are joined by identifier within a conversation, arguments are checked against the tools' schemas, and
messages are put in an order where a result follows its call and a call follows the results it refers to. Messages are
serialised one by one as canonical JSON, so a conversation of any length is never gathered into one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import HOT_SHARE, hot_join, materialise

#: Turns of a conversation that are numbered by one window.
TURNS_PER_PART = 1024
#: JSON types and the names of them that schema_of_variant gives.
JSON_TYPES = {"string": "STRING", "integer": "(?:BIGINT)", "number": "(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = True


@dataclass(frozen=True)
class Tool:
    """closed: no other arguments than fields."""

    name: str
    fields: tuple[Field, ...]
    closed: bool = True


def json_text(value: Column) -> Column:
    """A string as a JSON value; null is null."""
    listed = F.to_json(F.array(value.cast("string")), {"ignoreNullFields": "false"})
    return listed.substr(F.lit(2), F.length(listed) - 2)


def _embedded(messages: DataFrame) -> DataFrame:
    """messages with parsed: tool_calls and content of the assistant messages whose JSON has a call; null for others."""
    looks = (F.col("role") == "assistant") & F.col("text").rlike(r'(?s)^\s*\{.*"tool_calls".*\}\s*$')
    parsed = F.when(looks, F.from_json("text", "struct<tool_calls: array<struct<id: string, name: string, arguments: string>>, content: string>"))
    has_call = F.exists(parsed["tool_calls"], lambda c: c.isNotNull())
    return messages.select("conv_id", "turn", "role", "text", F.when(has_call, parsed).alias("parsed"))


def embedded_calls(messages: DataFrame) -> DataFrame:
    """Calls in assistant messages whose text is {"tool_calls": [{"id", "name", "arguments"}, ...]}, with one at least."""
    found = _embedded(messages).filter("parsed IS NOT NULL").select("conv_id", "turn", F.posexplode("parsed.tool_calls").alias("pos", "call"))
    return found.select("conv_id", "turn", "pos", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"))


def embedded_results(messages: DataFrame) -> DataFrame:
    """Results in tool messages whose text is {"tool_call_id", "content"}."""
    got = F.from_json("text", "struct<tool_call_id: string, content: string>")
    return messages.filter(F.col("role") == "tool").select("conv_id", "turn", F.lit(0).alias("pos"), got["tool_call_id"].alias("call_id"), F.coalesce(got["content"], "text").alias("content"))


def arguments_valid(name: Column, arguments: Column, tools: tuple[Tool, ...]) -> Column:
    """Whether arguments are a JSON object that the tool's schema allows; false for unknown tools and broken JSON."""
    value = F.try_parse_json(arguments)
    verdict = F.lit(False)
    for tool in tools:
        tests = F.schema_of_variant(value).rlike("^OBJECT<")
        for f in tool.fields:
            kind = F.schema_of_variant(F.try_variant_get(value, f"$['{f.name}']", "variant"))
            tests = tests & F.coalesce(kind.rlike(f"^{JSON_TYPES[f.type]}$"), F.lit(not f.required))
        if tool.closed:
            tests = tests & (F.size(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(f.name) for f in tool.fields]))) == 0)
        verdict = F.when(name == tool.name, F.coalesce(tests, F.lit(False))).otherwise(verdict)
    return verdict


def _key(call_id: str) -> Column:
    """Conversation and identifier as one key; null without an identifier."""
    whole = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col(call_id).alias("call"))
    return F.when(F.col(call_id).isNotNull(), whole)


def _levels(nodes: DataFrame) -> DataFrame:
    """(key, at, level) of calls, from (key, turn, arguments, answer, answers, calls), resolved in topological rounds.

    at is the latest turn of a call and all it waits for; level counts the calls and results it waits for in a chain.
    A call that waits for itself, directly or not, has neither. References to results that do not exist are not waited
    for; a result without a call is there from the start. A round reads what is open and what the round before settled,
    and writes only that; rounds number as the longest chain of references.
    """
    refs = F.array_distinct(F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(r'"\$ref"\s*:\s*"([^"]+)"'), F.lit(1)))
    called = nodes.filter("calls > 0").select("key", "turn", refs.alias("refs"))
    free = called.filter("size(refs) = 0").select("key", F.col("turn").alias("at"), F.lit(0).alias("level"))
    edges = called.filter("size(refs) > 0").select("key", "turn", F.explode("refs").alias("ref")).withColumn("ref", F.struct("key.none", "key.conv", F.col("ref").alias("call")))
    if edges.isEmpty():
        return free
    targets = nodes.filter("answers > 0").select(F.col("key").alias("ref"), "answer", (F.col("calls") > 0).alias("waits"))
    met = edges.join(targets, "ref", "left")
    state = met.groupBy("key").agg(
        F.max(F.greatest("turn", "answer")).alias("at"), F.max(F.when(~F.col("waits"), F.lit(-1))).alias("before"), F.collect_list(F.when(F.col("waits"), F.struct("ref", "answer"))).alias("open")
    )
    state = materialise(state, "tool-rounds")
    done = [materialise(free, "tool-levels")]
    settled = lambda df: df.filter("size(open) = 0").select("key", "at", F.coalesce(F.col("before") + 2, F.lit(0)).alias("level"))
    done.append(settled(state))
    fresh = done[0].unionByName(done[1])
    while not fresh.isEmpty():
        of = fresh.select(F.col("key").alias("ref"), F.col("at").alias("got_at"), F.col("level").alias("got_level"))
        rows = state.filter("size(open) > 0").select("key", "at", "before", F.explode("open").alias("o")).withColumn("ref", F.col("o.ref")).join(of, "ref", "left")
        got = F.col("got_level").isNotNull()
        after = rows.groupBy("key").agg(
            F.max(F.greatest("at", F.when(got, F.greatest("got_at", "o.answer")))).alias("at"), F.max(F.greatest("before", "got_level")).alias("before"), F.collect_list(F.when(~got, F.col("o"))).alias("open")
        )
        state = materialise(after, "tool-rounds")
        fresh = settled(state)
        done.append(fresh)
    return reduce(DataFrame.unionByName, done)


def _placed(rows: DataFrame) -> DataFrame:
    """Written rows with position, from 1 within the conversation, in order of at, level, turn, pos, kind and a digest.

    A conversation is numbered in parts of TURNS_PER_PART turns. Parts with more than a thousandth of all rows (there are
    fewer than a thousand; rows without conversation may make one) are cut finer, down to 256th shares of one place.
    """
    part = F.when(F.col("in_cycle"), F.lit(1 << 40)).otherwise(F.coalesce(F.floor(F.col("at") / TURNS_PER_PART), F.lit(-1 << 40))).alias("part")
    order = ("at", "level", "turn", "pos", "kind")
    rows = rows.select("*", part, F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0).cast(rows.schema["conv_id"].dataType)).alias("conv")).alias("of"), F.md5("canonical").alias("digest"))
    sums = rows.groupBy("of", "part").agg(F.count("*").alias("n"))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(sums.filter(F.col("n") * HOT_SHARE > total).select("of", "part", F.lit(True).alias("hot")))
    fine = F.when(F.col("hot"), F.struct(*order, F.substring("digest", 1, 2).alias("share")))
    rows = rows.join(hot, ["of", "part"], "left").withColumn("fine", fine).drop("hot")
    pieces = rows.groupBy("of", "part", "fine").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("of").orderBy("part", "fine").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pieces.select(F.col("of").alias("k_of"), F.col("part").alias("k_part"), F.col("fine").alias("k_fine"), before.alias("before"))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("of", "part", "fine").orderBy(*order, "digest", "canonical")))
    placed = numbered.join(starts, (F.col("of") == F.col("k_of")) & (F.col("part") == F.col("k_part")) & F.col("fine").eqNullSafe(F.col("k_fine")))
    return placed.withColumn("position", F.col("before") + F.col("n"))


def link_tools(calls: DataFrame, results: DataFrame, others: DataFrame, tools: tuple[Tool, ...]) -> DataFrame:
    """All messages in topological order.

    calls: conv_id, turn, pos, call_id, name, arguments (JSON). results: conv_id, turn, pos, call_id, content.
    others: conv_id, turn, role, text.
    Returns conv_id, turn, kind (call, result, message), call_id, linked_turn (of a call its first result, of a result its
    call; null without one), args_valid (calls only), in_cycle, position (from 1 within the conversation), canonical.

    Of calls that repeat an identifier the first (by turn, then place) is the one that is linked; every result of an
    identifier is linked to it. A null identifier links nothing. Results without a call and calls in a cycle of references
    keep their turns, the latter after all that can be ordered. A null conversation is one like any other; null turns come
    first. Equal rows are all kept. Empty tables give empty ones; columns beyond those named are not read.
    """
    calls = calls.select("conv_id", "turn", "pos", "call_id", "name", "arguments").withColumn("key", _key("call_id"))
    results = results.select("conv_id", "turn", "pos", "call_id", "content").withColumn("key", _key("call_id"))
    of_calls = calls.select("key", F.struct("turn", "pos", "arguments").alias("call"), F.lit(None).cast("bigint").alias("answer"), F.lit(0).alias("answers"), F.lit(1).alias("calls"))
    of_results = results.select("key", F.lit(None).cast(of_calls.schema["call"].dataType).alias("call"), F.col("turn").cast("bigint").alias("answer"), F.lit(1).alias("answers"), F.lit(0).alias("calls"))
    nodes = of_calls.unionByName(of_results).filter("key IS NOT NULL").groupBy("key").agg(F.min("call").alias("call"), F.min("answer").alias("answer"), F.sum("answers").alias("answers"), F.sum("calls").alias("calls"))
    nodes = materialise(nodes.select("key", "call.turn", "call.arguments", "answer", "answers", "calls"), "tool-nodes")
    known = nodes.drop("arguments").join(_levels(nodes), "key", "left")
    known = materialise(known.select("key", F.col("turn").alias("first_turn"), "answer", "calls", "at", "level", (F.col("answers") + F.col("calls")).alias("uses")), "tool-links")

    linked = lambda df: hot_join(df, known, ["key"], "uses")
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), json_text(F.col("arguments")))
    canonical = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), json_text(F.col("call_id")), F.lit(',"name":'), json_text(F.col("name")), F.lit(',"type":"call"}'))
    cycle = F.col("key").isNotNull() & F.col("level").isNull()
    c = linked(calls).select("conv_id", "turn", "pos", F.lit("call").alias("kind"), "call_id", F.col("answer").alias("linked_turn"), arguments_valid(F.col("name"), F.col("arguments"), tools).alias("args_valid"), cycle.alias("in_cycle"), F.greatest("turn", "at").alias("at"), F.coalesce("level", F.lit(0)).alias("level"), canonical.alias("canonical"))

    canonical = F.concat(F.lit('{"content":'), json_text(F.col("content")), F.lit(',"id":'), json_text(F.col("call_id")), F.lit(',"type":"result"}'))
    called = F.coalesce(F.col("calls") > 0, F.lit(False))
    r = linked(results).select("conv_id", "turn", "pos", F.lit("result").alias("kind"), "call_id", F.when(called, F.col("first_turn")).alias("linked_turn"), F.lit(None).cast("boolean").alias("args_valid"), (called & F.col("level").isNull()).alias("in_cycle"), F.greatest("turn", "at").alias("at"), F.coalesce(F.col("level") + 1, F.lit(0)).alias("level"), canonical.alias("canonical"))

    canonical = F.concat(F.lit('{"role":'), json_text(F.col("role")), F.lit(',"text":'), json_text(F.col("text")), F.lit(',"type":"message"}'))
    none = F.lit(None)
    m = others.select("conv_id", "turn", F.lit(0).alias("pos"), F.lit("message").alias("kind"), none.cast("string").alias("call_id"), none.cast("bigint").alias("linked_turn"), none.cast("boolean").alias("args_valid"), F.lit(False).alias("in_cycle"), F.col("turn").alias("at"), F.lit(0).alias("level"), canonical.alias("canonical"))
    placed = _placed(materialise(c.unionByName(r).unionByName(m), "tool-messages"))
    return placed.select("conv_id", "turn", "kind", "call_id", "linked_turn", "args_valid", "in_cycle", "position", "canonical")


#: The table of conversations has no tools: a user's message is taken as a call of this one, the answer as its result.
REPLY = Tool("reply", (Field("text", "string"), Field("turn", "integer")))


def turns_as_tools(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other messages: those embedded as JSON, and user turns as calls that the next turn answers.

    An assistant message without embedded calls is an answer as it is, whatever its text; one with calls has its content,
    if any, as answer beside them. Null texts are calls and answers with a null text; a null role is another message; null
    conversations and turns stay null, and such turns answer nothing. Repeated messages each give their rows; an empty
    table gives empty ones.
    """
    call_id = lambda turn: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), turn.cast("string"))
    users = messages.filter("role = 'user'").select(
        "conv_id", "turn", F.lit(0).alias("pos"), call_id(F.col("turn")).alias("call_id"), F.lit(REPLY.name).alias("name"), F.to_json(F.struct("turn", "text"), {"ignoreNullFields": "false"}).alias("arguments")
    )
    said = _embedded(messages).filter("role = 'assistant' AND (parsed IS NULL OR parsed.content IS NOT NULL)")
    content = F.when(F.col("parsed").isNull(), F.col("text")).otherwise(F.col("parsed.content"))
    answers = said.select("conv_id", "turn", F.lit(0).alias("pos"), call_id(F.col("turn") - 1).alias("call_id"), content.alias("content"))
    others = messages.filter(F.coalesce(~F.col("role").isin("user", "assistant", "tool"), F.lit(True))).select("conv_id", "turn", "role", "text")
    return users.unionByName(embedded_calls(messages)), answers.unionByName(embedded_results(messages)), others
