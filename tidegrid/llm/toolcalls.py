"""Chat formatting: linking tool calls to results, ordering them, validating arguments, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, with_prefix

#: Per tool its arguments: the type as variants name it, and whether the argument must be there.
Schemas = dict[str, dict[str, tuple[str, bool]]]

#: In a plain conversation a user's turn asks for a reply, which the assistant's next turn gives.
REPLY: Schemas = {"reply": {"text": ("STRING", True)}}

MARKUP = "tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string, content string"
ROLES = ("system", "user", "assistant", "tool")
#: A string argument of this form asks for the result of another call of the conversation.
REFERENCE = r'"\$result:([^"\\]+)"'


def _problem(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Why a call's arguments don't fit its tool's schema; null if they do."""
    parsed, keys = F.try_parse_json(arguments), F.json_object_keys(arguments)
    out = F.when(~name.isin(*schemas) | name.isNull(), F.lit("unknown tool")).when(keys.isNull(), F.lit("arguments are no object"))
    for tool, fields in schemas.items():
        mine = name == tool
        allowed = F.array(*[F.lit(x) for x in fields]) if fields else F.array().cast("array<string>")
        out = out.when(mine & (F.size(F.array_except(keys, allowed)) > 0), F.lit("unknown argument"))
        for field, (kind, required) in fields.items():
            if required:
                out = out.when(mine & ~F.array_contains(keys, field), F.lit("missing argument"))
            found = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
            out = out.when(mine & F.array_contains(keys, field) & (found != kind), F.lit("argument of another type"))
    return out


def _ordered(calls: DataFrame) -> DataFrame:
    """Adds to each call its depth (the calls whose results it needs come first), the turn from which it can stand,
    and whether it hangs in a circle.  Each round settles the calls that wait for none; without references there is
    no round."""
    same = ["conv", "call_id"]
    state = calls.select(*same, F.lit(0).alias("depth"), F.greatest("turn", F.coalesce("answered", "turn")).alias("ready"), F.col("turn").alias("stands")).groupBy(*same).agg(F.min("depth").alias("depth"), F.max("ready").alias("ready"), F.max("stands").alias("stands"))
    edges = calls.select(*same, F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))).alias("needs")).distinct()
    edges = materialise(edges.join(calls.select(F.col("conv").alias("c2"), F.col("call_id").alias("needs2")).distinct(), F.col("conv").eqNullSafe(F.col("c2")) & (F.col("needs") == F.col("needs2")), "left_semi"))
    if edges.isEmpty():
        return state.withColumn("circle", F.lit(False))
    state = materialise(state.withColumn("circle", F.lit(False)))
    open_edges = edges
    while not open_edges.isEmpty():
        waiting = open_edges.select(F.col("conv").alias("wc"), F.col("call_id").alias("wi")).distinct()
        free = materialise(open_edges.join(waiting, F.col("conv").eqNullSafe(F.col("wc")) & (F.col("needs") == F.col("wi")), "left_anti"))
        if free.isEmpty():
            stuck = waiting.withColumn("__stuck", F.lit(True))
            return state.join(stuck, F.col("conv").eqNullSafe(F.col("wc")) & (F.col("call_id") == F.col("wi")), "left").withColumn("circle", F.coalesce("__stuck", F.lit(False))).drop("wc", "wi", "__stuck")
        parent = state.select(F.col("conv").alias("pc"), F.col("call_id").alias("pi"), F.col("depth").alias("pd"), F.col("ready").alias("pr"))
        gained = free.join(parent, F.col("conv").eqNullSafe(F.col("pc")) & (F.col("needs") == F.col("pi"))).groupBy(F.col("conv").alias("gc"), F.col("call_id").alias("gi")).agg(F.max("pd").alias("gd"), F.max("pr").alias("gr"))
        state = materialise(
            state.join(gained, F.col("conv").eqNullSafe(F.col("gc")) & (F.col("call_id") == F.col("gi")), "left").select(
                *same, F.greatest("depth", F.coalesce(F.col("gd") + 1, "depth")).alias("depth"), F.greatest("ready", F.coalesce("gr", "ready")).alias("ready"), F.greatest("stands", F.coalesce("gr", "stands")).alias("stands"), "circle"
            )
        )
        done = free.select(F.col("conv").alias("dc"), F.col("call_id").alias("di"), F.col("needs").alias("dn"))
        open_edges = materialise(open_edges.join(done, F.col("conv").eqNullSafe(F.col("dc")) & (F.col("call_id") == F.col("di")) & (F.col("needs") == F.col("dn")), "left_anti"))
    return state


def link(messages: DataFrame, *, schemas: Schemas = REPLY, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per item of each conversation, in an order in which every result follows its call.

    An assistant's text that is a JSON object with ``tool_calls`` makes calls; a ``tool`` text with ``tool_call_id``
    gives a result.  Otherwise a user's turn is a call of ``reply`` under the identifier ``turn-<n>`` (its number among
    the user's turns), and the assistant's next text its result.  Calls and results are joined by conversation and
    identifier.  Returns ``conv_id, turn, item, role, kind`` (call, result or message), ``call_id, position`` (from 0),
    ``linked, valid, problem, json``.

    Null conversation ids form one conversation.  Null turns come first.  Null texts count as empty.  Roles that are
    null or unknown make messages that aren't valid.  Repeated rows are items of their own; of several results for an
    identifier each is linked, of several calls too.  A call or result without its counterpart stays, not linked.
    Calls that wait for each other in a circle stay at their turns, not valid.  Empty table: no rows.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    asks = (F.coalesce(F.col("role") == "user", F.lit(False))).cast("long")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.xxhash64("text")]
    rows = with_prefix(rows, order, {"asked": asks, "__all": F.lit(1).cast("long")}).drop("__all")
    before = rows.groupBy("conv").agg(F.min("asked").alias("first")).withColumnRenamed("conv", "conv2")
    rows = materialise(rows.join(before, F.col("conv").eqNullSafe(F.col("conv2"))).withColumn("nth", F.col("asked") - F.col("first")).drop("conv2", "asked", "first"))

    marked = F.when(F.col("text").startswith("{") & F.col("role").isin("assistant", "tool"), F.from_json("text", MARKUP))
    rows = rows.withColumn("m", marked)
    makes = (F.col("role") == "assistant") & (F.coalesce(F.size("m.tool_calls"), F.lit(0)) > 0)
    gives = (F.col("role") == "tool") & F.col("m.tool_call_id").isNotNull()
    one = lambda kind, call_id, name, arguments, content: F.struct(F.lit(kind).alias("kind"), call_id.cast("string").alias("call_id"), name.cast("string").alias("name"), arguments.cast("string").alias("arguments"), content.cast("string").alias("content"))
    none = F.lit(None)
    items = (
        F.when(makes, F.transform("m.tool_calls", lambda c: one("call", c["id"], c["name"], c["arguments"], none)))
        .when(gives, F.array(one("result", F.col("m.tool_call_id"), none, none, F.coalesce("m.content", F.lit("")))))
        .when(F.col("role") == "user", F.array(one("call", F.concat(F.lit("turn-"), F.col("nth") + 1), F.lit("reply"), F.to_json(F.struct("text")), none)))
        .when((F.col("role") == "assistant") & (F.col("nth") > 0), F.array(one("result", F.concat(F.lit("turn-"), F.col("nth")), none, none, F.col("text"))))
        .otherwise(F.array(one("message", none, none, none, F.col("text"))))
    )
    items = materialise(rows.select("conv", "turn", "role", F.posexplode(items).alias("item", "x")).select("conv", "turn", "role", "item", "x.*"))

    results = items.where("kind = 'result'").groupBy(F.col("conv").alias("rc"), F.col("call_id").alias("ri")).agg(F.min("turn").alias("answered"))
    calls = items.where("kind = 'call'").join(results.hint("shuffle_hash"), F.col("conv").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "left").drop("rc", "ri")
    state = _ordered(calls).select(F.col("conv").alias("sc"), F.col("call_id").alias("si"), "depth", "stands", "circle")
    answers = results.select(F.col("rc"), F.col("ri"), F.lit(True).alias("has_result"))
    all_items = (
        items.join(state.hint("shuffle_hash"), F.col("conv").eqNullSafe(F.col("sc")) & (F.col("call_id") == F.col("si")), "left")
        .join(answers.hint("shuffle_hash"), F.col("conv").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "left")
    )
    linked = F.when(F.col("kind") == "call", F.coalesce("has_result", F.lit(False))).when(F.col("kind") == "result", F.col("si").isNotNull()).otherwise(False)
    problem = (
        F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "unknown role")
        .when(F.coalesce("circle", F.lit(False)) & (F.col("kind") == "call"), "circle of calls")
        .when(F.col("kind") == "call", _problem(F.col("name"), F.col("arguments"), schemas))
        .when((F.col("kind") == "result") & F.col("si").isNull(), "result without call")
        .when((F.col("kind") == "message") & (F.col("content") == ""), "empty message")
    )
    arguments = F.try_parse_json("arguments")  # keys come sorted from a variant
    json = F.when(F.col("kind") == "call", F.to_json(F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), "name", F.lit("call").alias("type")))).when(
        F.col("kind") == "result", F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("type")))
    ).otherwise(F.to_json(F.struct("content", "role", F.lit("message").alias("type"))))
    stands = F.when(F.col("kind") == "message", F.col("turn")).otherwise(F.greatest("turn", F.coalesce("stands", "turn")))
    out = all_items.select("conv", "turn", "item", "role", "kind", "call_id", linked.alias("linked"), problem.alias("problem"), json.alias("json"), stands.alias("stands"), F.coalesce("depth", F.lit(0)).alias("depth"))
    order = [F.col("conv").asc_nulls_first(), F.col("stands").asc_nulls_first(), F.col("depth"), F.when(F.col("kind") == "result", 1).otherwise(0), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.xxhash64("json"), F.col("item")]
    out = with_prefix(out, order, {"place": F.lit(1).cast("long")})
    start = out.groupBy(F.col("conv").alias("conv2")).agg(F.min("place").alias("start"))
    return out.join(start, F.col("conv").eqNullSafe(F.col("conv2"))).select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), "item", F.col("role").alias(role), "kind", "call_id", (F.col("place") - F.col("start")).alias("position"), "linked", F.col("problem").isNull().alias("valid"), "problem", "json"
    )


def op9_link_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))


#: The tables hold plain conversations, so the SQL has the rules for those.
OP9_SQL = """
WITH a AS (SELECT *, coalesce(text, '') AS t,
             sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations),
     b AS (SELECT *, CASE WHEN role = 'user' THEN 'call' WHEN role = 'assistant' AND nth > 0 THEN 'result' ELSE 'message' END AS kind FROM a),
     c AS (SELECT *, CASE WHEN kind <> 'message' THEN 'turn-' || nth END AS call_id FROM b)
SELECT conv_id, turn, CAST(0 AS INTEGER) AS item, role, kind, call_id,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
       CASE kind WHEN 'call' THEN count(CASE WHEN kind = 'result' THEN 1 END) OVER (PARTITION BY conv_id, nth) > 0 WHEN 'result' THEN true ELSE false END AS linked,
       NOT (kind = 'message' AND t = '') AS valid,
       CASE WHEN kind = 'message' AND t = '' THEN 'empty message' END AS problem,
       CAST(CASE kind WHEN 'call' THEN json_object('arguments', json_object('text', t), 'id', call_id, 'name', 'reply', 'type', 'call')
                      WHEN 'result' THEN json_object('content', t, 'id', call_id, 'type', 'result')
                      ELSE json_object('content', t, 'role', role, 'type', 'message') END AS VARCHAR) AS json
FROM c
"""
