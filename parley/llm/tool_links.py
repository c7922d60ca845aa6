"""Tool calls joined to their results, in an order that respects dependencies, as canonical JSON.

Calls and results meet in a hash join on (conversation, identifier). Calls are ordered so that what
a call needs comes first, by level. Chains of calls with one need each are climbed by doubling, and
calls with several needs are placed in rounds, as many as such calls follow each other. Arguments
are checked against the schema of their tool, field by field, and messages are written with sorted
keys and no blanks. Column functions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import staged
from parley.operators.positions import with_position
from parley.session import durable, scratch_path

#: What ``schema_of_variant`` calls the values that a JSON type allows.
KINDS = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": r"BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)",
    "boolean": "BOOLEAN",
    "array": "ARRAY<.*>",
    "object": "OBJECT<.*>",
}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and without blanks; NULL if it is not JSON."""
    return F.to_json(F.try_parse_json(json))


def problems(tool: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with arguments (JSON text), as a sorted array of short texts.

    ``schemas``: for each tool its fields, with JSON type and whether they are required. A field
    that is JSON null counts as absent. Fields that no schema names are reported.
    """
    parsed = F.try_parse_json(arguments)
    shape = F.schema_of_variant(parsed)
    cases = F.lit(None).cast("array<string>")
    for name, fields in schemas.items():
        found = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            actual = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
            absent = F.lit(f"missing:{field}") if required else F.lit(None).cast("string")
            found.append(
                F.when(actual == "VOID", absent).when(~actual.rlike(f"^({KINDS[kind]})$"), F.lit(f"type:{field}"))
            )
        keys = F.coalesce(F.json_object_keys(F.to_json(parsed)), F.array().cast("array<string>"))
        unknown = F.array_except(keys, F.array(*[F.lit(f) for f in sorted(fields)]))
        told = F.concat(F.array_compact(F.array(*found)), F.transform(unknown, lambda k: F.concat(F.lit("unknown:"), k)))
        cases = F.when(tool == name, F.array_sort(told)).otherwise(cases)
    wrong = F.when(parsed.isNull(), F.array(F.lit("not json"))).when(
        ~F.coalesce(shape.rlike("^OBJECT<"), F.lit(False)), F.array(F.lit("not an object"))
    )
    return F.coalesce(wrong, cases, F.array(F.lit("unknown tool")))


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv, id, level) of calls (conv, id): 0 for calls without needs, else one above all they need.

    ``needs`` holds (conv, id, needed); what is not among the calls is no need. Calls in a cycle, or
    behind one, keep level NULL. Runs of calls with one need each are climbed by doubling, so a chain
    takes rounds with the logarithm of its length; what is left are calls with several needs, which
    are placed round by round. Every round is stored, so that a lost executor repeats one round.
    """
    known = calls.select("conv", "id").distinct()
    asked = needs.join(known, ["conv", "id"], "left_semi").join(
        known.select("conv", F.col("id").alias("needed")), ["conv", "needed"], "left_semi"
    )
    asked = durable(asked.distinct())
    counted = asked.groupBy("conv", "id").agg(F.count("*").alias("n"), F.min("needed").alias("up"))
    nodes = staged(known.join(counted, ["conv", "id"], "left").fillna(0, ["n"]), "tool-nodes")
    roots = nodes.filter("n = 0").select("conv", "id", F.lit(0).cast("long").alias("level"))
    climbed = climb(nodes)
    found = roots.unionByName(
        climbed.filter("above <> 2").select(
            "conv", "id", F.when(F.col("above") == 0, F.col("steps")).alias("level")
        )
    )
    if nodes.filter("n > 1").limit(1).count():
        branches = nodes.filter("n > 1").select("conv", "id")
        placed = branched(asked.join(branches, ["conv", "id"], "left_semi"), nodes, climbed)
        tops = placed.select("conv", F.col("id").alias("up"), F.col("level").alias("_top"))
        behind = climbed.filter("above = 2").join(tops, ["conv", "up"], "left")
        found = found.unionByName(branches.join(placed, ["conv", "id"], "left")).unionByName(
            behind.select("conv", "id", (F.col("_top") + F.col("steps")).alias("level"))
        )
    return found


def climb(nodes: DataFrame) -> DataFrame:
    """(conv, id, up, steps, above) of the calls of ``nodes`` (conv, id, n, up) with exactly one need.

    ``up`` is the first call above that has none (``above`` 0) or several needs (``above`` 2),
    ``steps`` away; calls in a cycle, or behind one, have ``above`` 1. As long as a call that is in
    no cycle is on its way, some call arrives in the next round: no arrival ends the rounds.
    """
    kinds = nodes.select("conv", F.col("id").alias("up"), F.least("n", F.lit(2)).cast("int").alias("above"))
    single = nodes.filter("n = 1").select("conv", "id", "up", F.lit(1).cast("long").alias("steps"))
    state = staged(single.join(kinds, ["conv", "up"]).select("conv", "id", "up", "steps", "above"), "tool-climb")
    before = -1
    while (open_ := state.filter("above = 1").count()) not in (0, before):
        before = open_
        higher = state.select(
            "conv",
            F.col("id").alias("up"),
            F.col("up").alias("_up"),
            F.col("steps").alias("_steps"),
            F.col("above").alias("_above"),
        )
        moved = state.filter("above = 1").join(higher, ["conv", "up"])
        moved = moved.select(
            "conv",
            "id",
            F.col("_up").alias("up"),
            (F.col("steps") + F.col("_steps")).alias("steps"),
            F.col("_above").alias("above"),
        )
        state = staged(state.filter("above <> 1").unionByName(moved), "tool-climb")
    return state


def branched(asked: DataFrame, nodes: DataFrame, climbed: DataFrame) -> DataFrame:
    """(conv, id, level) of the calls of ``asked`` (conv, id, needed), which have several needs each.

    Needs are followed up to the next call with none or several needs, so that rounds count calls
    with several needs only. Calls in a cycle, or behind one, are not in the result.
    """
    tops = climbed.select("conv", F.col("id").alias("needed"), "up", "steps", "above")
    first = nodes.select("conv", F.col("id").alias("needed"), "n")
    edges = asked.join(first, ["conv", "needed"]).join(tops, ["conv", "needed"], "left")
    root = (F.col("n") == 0) | F.coalesce(F.col("above") == 0, F.lit(False))
    far = F.coalesce("steps", F.lit(0)) + 1
    edges = edges.select(
        "conv",
        "id",
        F.coalesce("up", "needed").alias("needed"),
        far.alias("far"),
        F.when(root, far).alias("level"),
    )
    edges = durable(edges)
    folder, number = scratch_path(asked.sparkSession, "tool-levels"), 0
    shape = nodes.select("conv", "id", F.lit(None).cast("long").alias("level")).schema
    session = asked.sparkSession
    while True:
        ready = edges.groupBy("conv", "id").agg(
            F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("_open")
        )
        path = f"{folder}/round={number}"
        ready.filter("_open = 0").drop("_open").write.parquet(path)
        last = session.read.schema(shape).parquet(path)
        if not last.limit(1).count():
            break
        gone = last.select("conv", "id")
        new = last.select("conv", F.col("id").alias("needed"), F.col("level").alias("_new"))
        left = edges.join(gone, ["conv", "id"], "left_anti").join(new, ["conv", "needed"], "left")
        met = F.coalesce("level", F.col("_new") + F.col("far"))
        edges = durable(left.select("conv", "id", "needed", "far", met.alias("level")))
        number += 1
    return session.read.schema(shape).parquet(f"{folder}/round=*")


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per call and per result without a call, with its place in the conversation's order.

    ``calls`` holds (conv, id, at, tool, arguments, needs: array of ids), ``results`` (conv, id, at,
    content). Result: conv, id, place (from 1), state (``linked``, ``unanswered``, ``orphan`` for a
    result without a call, ``cycle``, ``repeated``), problems, message (canonical JSON; arguments that are no
    JSON go in as ``arguments_text``). A need named twice is one. Of calls or results that repeat an identifier the first by ``at`` counts (then
    by tool and arguments, or content); the others are rows of their own, ``repeated`` and never linked, of
    which each copy stays. Rows with a NULL conversation or identifier are kept and never linked. Places
    follow level, ``at`` and identifier; orphans come after calls in cycles, and repeated rows last.
    """

    def first(rows: DataFrame, values: list[str], name: str) -> tuple[DataFrame, DataFrame]:
        """The first row of each identifier, and all others."""
        told = rows.filter(F.col("conv").isNotNull() & F.col("id").isNotNull()).select("conv", "id", "at", *values)
        # stored with a number, so that of equal rows one is the first
        told = staged(told.withColumn("_row", F.monotonically_increasing_id()), name)
        found = told.groupBy("conv", "id").agg(F.min(F.struct("at", *values, "_row")).alias("r"), F.count("*").alias("n"))
        found = staged(found, f"{name}-first")
        several = found.filter("n > 1").select("conv", "id", F.col("r._row").alias("_kept"))
        others = told.join(several, ["conv", "id"]).filter("_row <> _kept").drop("_row", "_kept")
        return found.select("conv", "id", "r.*").drop("_row"), others

    named, more_calls = first(calls, ["tool", "arguments", "needs"], "tool-calls")
    answers, more_results = first(results, ["content"], "tool-results")
    answers = answers.withColumnsRenamed({"conv": "_conv", "id": "_id", "at": "_at"})
    needs = named.select("conv", "id", F.explode(F.array_distinct("needs")).alias("needed"))
    order = levels(named, needs)
    calls = calls.select("conv", "id", "at", "tool", "arguments", "needs")
    results = results.select("conv", "id", "at", "content")
    joined = named.join(order, ["conv", "id"]).withColumn("call", F.lit(True))
    joined = joined.join(
        answers, (F.col("conv") == F.col("_conv")) & (F.col("id") == F.col("_id")), "full"
    ).withColumns({"conv": F.coalesce("conv", "_conv"), "id": F.coalesce("id", "_id"), "at": F.coalesce("at", "_at")})
    unnamed = F.col("conv").isNull() | F.col("id").isNull()
    lost_calls = calls.filter(unnamed).withColumns({"call": F.lit(True), "level": F.lit(0)}).drop("needs")
    lost_results = results.filter(unnamed).withColumn("_at", F.col("at"))
    again = F.lit(True)
    rows = (
        joined.drop("_conv", "_id", "needs")
        .unionByName(lost_calls, allowMissingColumns=True)
        .unionByName(lost_results, allowMissingColumns=True)
        .withColumn("again", F.lit(False))
        .unionByName(more_calls.drop("needs").withColumns({"call": F.lit(True), "again": again}), allowMissingColumns=True)
        .unionByName(more_results.withColumns({"_at": F.col("at"), "again": again}), allowMissingColumns=True)
    )
    is_call, answered = F.col("call").isNotNull(), F.col("_at").isNotNull()
    state = (
        F.when(F.col("again"), "repeated")
        .when(~is_call, "orphan")
        .when(F.col("level").isNull(), "cycle")
        .when(answered, "linked")
        .otherwise("unanswered")
    )
    wrong = F.when(is_call, problems(F.col("tool"), F.col("arguments"), schemas))
    rows = rows.withColumns({"state": state, "problems": wrong, "_call": F.when(F.col("again"), 2).when(is_call, 0).otherwise(1)})
    rows = rows.withColumn("_level", F.coalesce("level", F.lit(1 << 62)))
    ordered = with_position(rows, ["conv"], ["_call", "_level", "at", "id"], "place", native=True)
    return ordered.select("conv", "id", "place", "state", "problems", message().alias("message"))


def message() -> Column:
    """The row as canonical JSON: arguments, content, id, problems, state, tool; absent ones left out."""
    fields = F.to_json(
        F.struct(
            F.try_parse_json(F.col("arguments")).alias("arguments"),
            F.when(F.try_parse_json(F.col("arguments")).isNull(), F.col("arguments")).alias("arguments_text"),
            F.col("content").alias("content"),
            F.col("id").alias("id"),
            F.when(F.size("problems") > 0, F.col("problems")).alias("problems"),
            F.col("state").alias("state"),
            F.col("tool").alias("tool"),
        )
    )
    return canonical(fields)
