"""Tool-call linking: calls and results are joined by identifier, ordered, validated and written as canonical JSON.

Both sides are summed to one row an identifier before they meet, so copies of a conversation never multiply. All but the
levels of calls with several needs are Spark expressions; JSON is parsed as VARIANT, whose objects keep their keys sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialise

#: A tool's parameters: name -> (JSON type, whether it must be there[, limits]). Limits are of those that LIMITS names.
Schemas = dict[str, dict[str, tuple]]
LIMITS = ("min_length", "max_length", "minimum", "maximum", "enum")
#: What schema_of_variant() says of each JSON type.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}

CALLS = "array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>"


def calls_of_messages(messages: DataFrame) -> DataFrame:
    """Calls (conv_id, turn, call_id, name, arguments, depends_on) in messages whose text is {"tool_calls": [...]}.

    Arguments may be an object or a string that holds one. Messages that are no such JSON have no calls.
    """
    parsed = messages.where(F.col("role") == "assistant").select("conv_id", "turn", F.from_json("text", f"tool_calls {CALLS}").alias("m"))
    one = parsed.select("conv_id", "turn", F.explode("m.tool_calls").alias("c"))
    return one.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))


def results_of_messages(messages: DataFrame) -> DataFrame:
    """Results (conv_id, turn, call_id, content) in messages of the role tool whose text is {"tool_call_id": ..., "content": ...}."""
    parsed = messages.where(F.col("role") == "tool").select("conv_id", "turn", F.from_json("text", "tool_call_id string, content string").alias("m"))
    return parsed.select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("content")).where(F.col("call_id").isNotNull())


def turns_as_calls(conversations: DataFrame, tools: tuple[str, str] = ("reply", "follow_up")) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn calls the first tool at the start (turns 0 and 1) and the second one
    later, and the assistant's next turn is the result.

    The identifier is conv_id:turn of the user's turn; turns that end with 6 or 7 go on with the turn before, so they repeat its
    identifier. A call needs those of the two user's turns before it, as far as turns go back.
    """
    turn = F.col("turn")
    identifier = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), F.when((t % 10).isin(6, 7), t - 2).otherwise(t).cast("string"))
    arguments = F.to_json(F.struct(F.col("text").alias("text"), turn.alias("turn")))
    needs = F.filter(F.array(*[F.when(turn >= back, identifier(turn - back)) for back in (2, 4)]), lambda x: x.isNotNull())
    whole = conversations.where(F.col("conv_id").isNotNull() & turn.isNotNull())
    calls = whole.where(F.col("role") == "user").select("conv_id", "turn", identifier(turn).alias("call_id"), F.when(turn < 2, tools[0]).otherwise(tools[1]).alias("name"), arguments.alias("arguments"), F.array_remove(needs, identifier(turn)).alias("depends_on"))
    results = whole.where(F.col("role") == "assistant").select("conv_id", "turn", identifier(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def beyond(value: Column, kind: str, name: str, limit: object) -> tuple[Column, str]:
    """Whether a value (VARIANT) of a JSON type breaks a limit, and what to say then."""
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    found = {
        "min_length": lambda: (F.length(text) < limit, "too short"),
        "max_length": lambda: (F.length(text) > limit, "too long"),
        "minimum": lambda: (number < limit, "too small"),
        "maximum": lambda: (number > limit, "too large"),
        "enum": lambda: (~text.isin([str(x) for x in limit]), "not allowed"),
    }
    return found[name]()


def violations(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with arguments (VARIANT) under the schema of name: an array of texts, empty if nothing is."""
    checks = [F.when(~name.isin(list(schemas)) | name.isNull(), F.concat(F.lit("unknown tool: "), F.coalesce(name, F.lit("")))), F.when(arguments.isNull(), F.lit("arguments are no JSON"))]
    for tool, parameters in schemas.items():
        for p, (kind, required, *limits) in parameters.items():
            value = F.try_variant_get(arguments, f"$.{p}", "variant")
            found = F.schema_of_variant(value)
            absent, sound = found.isNull() | (found == "VOID"), found.rlike(f"^{KINDS[kind]}$")
            if required:
                checks.append(F.when((name == tool) & arguments.isNotNull() & absent, F.lit(f"missing: {p}")))
            checks.append(F.when((name == tool) & ~absent & ~sound, F.lit(f"not {kind}: {p}")))
            for limit, at in (limits[0] if limits else {}).items():
                broken, said = beyond(value, kind, limit, at)
                checks.append(F.when((name == tool) & ~absent & sound & broken, F.lit(f"{said}: {p}")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each (conv_id, call_id) among calls and results.

    Of several calls, and of several results, with one identifier the first counts, by turn and then by content;
    n_calls and n_results say how many there were. status: linked, unanswered, orphan (a result without its call) or
    early (the result's turn is before the call's). Null identifiers are dropped.
    """
    key = ["conv_id", "call_id"]
    c = calls.where(F.col("call_id").isNotNull()).groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    r = results.where(F.col("call_id").isNotNull()).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    both = c.join(r, key, "full")
    status = F.when(F.col("c").isNull(), "orphan").when(F.col("r").isNull(), "unanswered").when(F.col("r.turn") < F.col("c.turn"), "early").otherwise("linked")
    return both.select(
        *key, F.col("c.turn").alias("turn"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"),
        F.coalesce(F.col("c.depends_on"), F.array().cast("array<string>")).alias("depends_on"), F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"),
    )


KEY = ["conv_id", "call_id"]
#: The most needs of a conversation's calls that one task holds together.
MOST_NEEDS = 200_000


def chains(single: DataFrame) -> DataFrame:
    """conv_id, call_id, to, steps of calls with one need (conv_id, call_id, to): the first call on their way that has none or several.

    Pointers double, so the rounds grow with the logarithm of the longest way. Calls whose way never ends (a cycle) are left out.
    """
    heads = single.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("more"))
    state = single.withColumn("steps", F.lit(1)).join(heads, ["conv_id", "to"], "left").select(*KEY, "to", "steps", F.col("more").isNull().alias("done"))
    state, left = materialise(state, "chains"), None
    while (now := state.where("not done").count()) and now != left:
        left = now
        after = state.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"), F.col("done").alias("done2"))
        moved = state.where("not done").join(after, ["conv_id", "to"]).select(*KEY, F.col("to2").alias("to"), (F.col("steps") + F.col("steps2")).cast("int").alias("steps"), F.col("done2").alias("done"))
        state = materialise(state.where("done").unionByName(moved), "chains")
    return state.where("done").drop("done")


def ordered(linked: DataFrame) -> DataFrame:
    """linked with level: the calls on the longest way of needs that leads to a call; so none comes before one it needs.

    A call without needs in its conversation has level 0. Calls on a cycle, or behind one, and results without a call have a
    null level. Needs that are not calls of the conversation don't count, nor does a need named twice. Ways through calls
    with one need each take rounds by their logarithm. Calls with several needs are levelled a conversation at a time where these
    have at most MOST_NEEDS between them, and in rounds, one for each step between such calls, in longer conversations.
    """
    calls = linked.where(F.col("turn").isNotNull())
    needs = calls.select(*KEY, F.explode(F.array_distinct("depends_on")).alias("to")).join(calls.select("conv_id", F.col("call_id").alias("to")), ["conv_id", "to"], "left_semi")
    needs = materialise(needs.select(*KEY, "to"), "needs")
    number = needs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.first("to").alias("to"))
    ways = chains(number.where("n = 1").select(*KEY, "to"))
    several = number.where("n > 1").select(*KEY)
    joint = _levels_of_joints(needs, ways, materialise(several, "joints"))
    roots = calls.select(*KEY).join(number.select(*KEY), KEY, "left_anti").withColumn("level", F.lit(0))
    known = materialise(roots.unionByName(joint), "levels")
    behind = ways.join(known.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("base")), ["conv_id", "to"])
    level = known.unionByName(behind.select(*KEY, (F.col("base") + F.col("steps")).cast("int").alias("level")))
    return linked.join(level, KEY, "left")


def _levels_of_joints(needs: DataFrame, ways: DataFrame, joints: DataFrame) -> DataFrame:
    """conv_id, call_id, level of the calls with several needs; those on or behind a cycle are left out."""
    if joints.isEmpty():
        return joints.limit(0).withColumn("level", F.lit(0))
    own = needs.join(joints, KEY, "left_semi")
    to = ways.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("end"), "steps")
    edges = own.join(to, ["conv_id", "to"], "left").select(*KEY, F.coalesce("end", "to").alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    has_need = needs.select("conv_id", F.col("call_id").alias("to")).distinct().withColumn("waits", F.lit(True))
    edges = materialise(edges.join(has_need, ["conv_id", "to"], "left").select(*KEY, "to", "steps", F.coalesce("waits", F.lit(False)).alias("waits")), "edges")
    long = materialise(edges.groupBy("conv_id").count().where(F.col("count") > MOST_NEEDS).select("conv_id"), "long")
    known = _levels_by_conversation(edges.join(long, "conv_id", "left_anti"))
    return known if long.isEmpty() else known.unionByName(_levels_by_rounds(edges.join(long, "conv_id", "left_semi")))


def _levels_by_conversation(edges: DataFrame) -> DataFrame:
    """The levels of joints by edges (conv_id, call_id, to, steps, waits), each conversation's together in one task."""

    def levels(of: dict[str, list[tuple[str, int, bool]]]) -> dict[str, int]:
        waiting = {x: sum(waits for _, _, waits in e) for x, e in of.items()}
        after: dict[str, list[tuple[str, int]]] = {}
        level = dict.fromkeys(of, 0)
        for x, e in of.items():
            for to, steps, waits in e:
                if waits:
                    after.setdefault(to, []).append((x, steps))
                else:
                    level[x] = max(level[x], steps)
        ready, done = [x for x, n in waiting.items() if n == 0], {}
        while ready:
            x = ready.pop()
            done[x] = level[x]
            for y, steps in after.get(x, ()):
                level[y] = max(level[y], level[x] + steps)
                waiting[y] -= 1
                if waiting[y] == 0:
                    ready.append(y)
        return done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, of, type_ = None, {}, pa.null()

        def made() -> pa.RecordBatch:
            found = levels(of)
            return pa.RecordBatch.from_arrays([pa.array([at] * len(found), type_), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())], names=[*KEY, "level"])

        for batch in batches:
            type_ = batch.schema.field(0).type
            for c, x, to, steps, waits in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if of and c != at:
                    yield made()
                    of = {}
                at = c
                of.setdefault(x, []).append((to, steps, waits))
        if of:
            yield made()

    conv = edges.schema["conv_id"].dataType.simpleString()
    return edges.select(*KEY, "to", "steps", "waits").repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(run, f"conv_id {conv}, call_id string, level int")


def _levels_by_rounds(edges: DataFrame) -> DataFrame:
    """The same, a round for each step between joints: for conversations that no task should hold."""
    known = edges.select(*KEY, F.lit(0).alias("level")).limit(0)
    while True:
        met = edges.join(known.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"], "left")
        base = F.when(F.col("waits"), F.col("level")).otherwise(F.lit(0))
        ready = met.groupBy(*KEY).agg(F.max(base + F.col("steps")).cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.count(base).alias("met")).where("n = met")
        more = materialise(ready.select(*KEY, "level").join(known.select(*KEY), KEY, "left_anti"), "joints")
        if more.isEmpty():
            return known
        known = materialise(known.unionByName(more), "joints")


def serialised(linked: DataFrame, schemas: Schemas) -> DataFrame:
    """linked with valid, violations (joined by "; ") and record: canonical JSON, keys sorted, no spaces, nulls left out."""
    parsed = F.try_parse_json("arguments")
    w = linked.withColumn("__arguments", parsed).withColumn("__wrong", F.when(F.col("status") == "orphan", F.array().cast("array<string>")).otherwise(violations(F.col("name"), F.col("__arguments"), schemas)))
    record = F.struct(
        F.col("__arguments").alias("arguments"), F.col("call_id"), F.col("content"), F.when(F.size("depends_on") > 0, F.array_sort("depends_on")).alias("depends_on"), F.col("level"), F.col("name"), F.col("status")
    )
    return w.select(*linked.columns, (F.size("__wrong") == 0).alias("valid"), F.array_join("__wrong", "; ").alias("violations"), F.to_json(record).alias("record"))
