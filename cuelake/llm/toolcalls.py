"""Tool calls of conversations: linked to results, ordered by need, checked against schemas, written as canonical JSON."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.plans.cut import durable

#: Types of JSON values by the names that Spark gives to variants.
TYPES = {"STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "VOID": "null"}
LINE = ["arguments", "errors", "id", "level", "name", "result", "status"]


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of calls (call_id, needs array): 0 without needs, else one above the highest need.

    Round by round, calls without open needs take the round's number and close the needs of others, so there are as
    many rounds as the longest chain has calls; each is cut at a checkpoint and reads only the needs still open.
    Needs that no call has are not waited for.  Calls in a circle, or that wait for one, get no level.
    """
    ids = calls.select("call_id")
    open_needs = (calls.select("call_id", F.explode("needs").alias("need")).distinct()
                  .join(ids.withColumnRenamed("call_id", "need"), "need", "left_semi"))
    open_needs, waiting = durable(open_needs), durable(ids)
    done, level = None, 0
    while True:
        free = durable(waiting.join(open_needs, "call_id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done = free if done is None else done.union(free)
        waiting = durable(waiting.join(free, "call_id", "left_anti"))
        open_needs = durable(open_needs.join(free.select(F.col("call_id").alias("need")), "need", "left_anti"))
        level += 1
    return done if done is not None else ids.withColumn("level", F.lit(0)).limit(0)


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call_id, errors) of the calls whose arguments break their schema; errors in order of their text.

    `schemas` has a row (tool, param, type, required) for each parameter; type is string, integer, number, boolean,
    object, array or null.  Errors are `missing p`, `type p` and `unknown p`.
    """
    parsed = calls.select("call_id", "name", F.try_parse_json("arguments").alias("v"))
    parsed = parsed.where(F.schema_of_variant("v").startswith("OBJECT"))
    given = (parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer()))
             .select("call_id", "name", F.col("key").alias("param"), F.schema_of_variant("value").alias("kind")))
    kind = F.lit(None).cast("string")
    for spark_name, json_name in TYPES.items():
        kind = F.when(F.col("kind") == spark_name, json_name).otherwise(kind)
    kind = F.when(F.col("kind").startswith("OBJECT"), "object").when(F.col("kind").startswith("ARRAY"), "array").otherwise(
        F.coalesce(kind, F.lit("number")))
    rules = schemas.select(F.col("tool").alias("name"), "param", "type", "required")
    checked = given.select("call_id", "name", "param", kind.alias("kind")).join(rules, ["name", "param"], "left")
    fits = (F.col("kind") == F.col("type")) | ((F.col("type") == "number") & (F.col("kind") == "integer"))
    wrong = checked.where(F.col("type").isNull() | ~fits).select(
        "call_id", F.concat(F.when(F.col("type").isNull(), "unknown ").otherwise("type "), "param").alias("error"))
    asked = parsed.select("call_id", "name").join(rules.where("required"), "name")
    missing = asked.join(given.select("call_id", "param"), ["call_id", "param"], "left_anti").select(
        "call_id", F.concat(F.lit("missing "), "param").alias("error"))
    return wrong.union(missing).groupBy("call_id").agg(F.sort_array(F.collect_set("error")).alias("errors"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call and each result without a call, with a canonical JSON `line`.

    `calls`: conv_id, turn, call_id, name, arguments (JSON text), needs (ids of calls it waits for).
    `results`: conv_id, turn, call_id, content.  The order within a conversation is (level, turn, call_id).

    An id names a call inside its conversation: calls, needs and results of different conversations never meet.
    status is the first that holds: `orphan result`, `no id`, `unknown tool`, `bad json` (no JSON object), `invalid
    arguments`, `circle`, `no result`, `ok`.  Of rows of a conversation that repeat an id the least by (turn, name, arguments), or by
    (turn, content), counts; `repeats` has the number of the others.  Calls without an id keep their rows and link with
    nothing; results without an id are orphans.  Null texts stay null in the line.  Further columns are ignored.
    """
    inside = lambda x: F.struct("conv_id", x.alias("id"))
    key = F.when(F.col("call_id").isNotNull(), inside(F.col("call_id"))).alias("call_id")
    calls = calls.select("conv_id", "turn", key, "name", "arguments", F.transform("needs", inside).alias("needs"))
    results = results.select("conv_id", "turn", key, "content")
    named = durable(calls.where("call_id IS NOT NULL").groupBy("call_id").agg(
        F.min(F.struct("turn", "name", "arguments", "conv_id", "needs")).alias("c"), (F.count(F.lit(1)) - 1).alias("repeats"))
        .select("call_id", "repeats", "c.*"))
    found = (results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("turn", "content", "conv_id")).alias("r"))
             .select("call_id", F.col("r.turn").alias("result_turn"), F.col("r.conv_id").alias("result_conv"),
                     F.col("r.content").alias("content"), F.lit(True).alias("answered")))
    tools = schemas.select(F.col("tool").alias("name")).distinct().withColumn("known", F.lit(True))
    rows = (named.join(levels(named), "call_id", "left").join(argument_errors(named, schemas), "call_id", "left")
            .withColumn("called", F.lit(True)).join(found.hint("shuffle_hash"), "call_id", "full").join(tools, "name", "left"))
    nameless = calls.where("call_id IS NULL").select("conv_id", "turn", "call_id", "name", "arguments", F.lit(True).alias("called"))
    lost = results.where("call_id IS NULL").select(
        F.col("conv_id").alias("result_conv"), F.col("turn").alias("result_turn"), "content", F.lit(True).alias("answered"))
    rows = rows.unionByName(nameless, True).unionByName(lost, True)

    parsed = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    status = (F.when(F.col("called").isNull(), "orphan result").when(F.col("call_id").isNull(), "no id")
              .when(F.col("known").isNull(), "unknown tool").when(~is_object, "bad json")
              .when(F.size("errors") > 0, "invalid arguments").when(F.col("level").isNull(), "circle")
              .when(F.col("answered").isNull(), "no result").otherwise("ok"))
    rows = rows.select(F.coalesce("conv_id", "result_conv").alias("conv_id"), F.coalesce("turn", "result_turn").alias("turn"),
                       F.col("call_id.id").alias("call_id"), F.col("call_id.id").alias("id"), "name", "level", status.alias("status"),
                       F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
                       F.coalesce("repeats", F.lit(0).cast("long")).alias("repeats"), F.when(is_object, parsed).alias("arguments"),
                       F.col("content").alias("result"))
    line = F.to_json(F.struct(*LINE), {"ignoreNullFields": "false"})
    return rows.select("conv_id", "turn", "call_id", "name", "level", "status", F.array_join("errors", ",").alias("errors"),
                       "repeats", line.alias("line"))


#: Tools of the query below: (tool, param, type, required).
SCHEMAS = [("search", "query", "string", True), ("search", "limit", "integer", False), ("count", "text", "string", True),
           ("translate", "text", "string", True), ("translate", "to", "string", True)]


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) read out of plain turns: a user's turn is a call, the assistant's next turn its result.

    The tool and its arguments follow from the text; texts of some lengths give broken JSON, missing or mistyped
    arguments, unknown tools, and needs of later calls, so that every branch of `link` has rows.  A call needs the
    conversation's call two turns before.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    name_of = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    rows = conversations.select("conv_id", "turn", "role", "text", n.alias("n"))
    user = rows.where("role = 'user'")
    name = F.when(F.expr("n % 17 = 0"), "guess").otherwise(F.element_at(F.array(*map(F.lit, ("search", "count", "translate"))), (F.col("n") % 3 + 1).cast("int")))
    given = F.when(F.expr("n % 7 <> 0"), F.col("text"))
    arguments = (F.when(F.expr("n % 3 = 0"), F.when(F.expr("n % 11 = 0"), F.to_json(F.struct(given.alias("query"), F.col("n").cast("string").alias("limit"))))
                        .otherwise(F.to_json(F.struct(given.alias("query"), F.col("n").alias("limit")))))
                 .when(F.expr("n % 3 = 1"), F.to_json(F.struct(given.alias("text"))))
                 .otherwise(F.to_json(F.struct(F.lit("en").alias("to"), given.alias("text")))))
    arguments = F.when(F.expr("n % 13 = 0"), F.expr("'{'")).otherwise(arguments)
    needs = F.when(F.expr("n % 5 = 0"), F.array(name_of(F.col("turn") - 2), name_of(F.col("turn") + 2))).otherwise(F.array(name_of(F.col("turn") - 2)))
    calls = user.select("conv_id", "turn", name_of(F.col("turn")).alias("call_id"), name.alias("name"),
                        arguments.alias("arguments"), F.array_compact(needs).alias("needs"))
    results = rows.where("role = 'assistant'").select("conv_id", "turn", name_of(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def schema_table(spark) -> DataFrame:
    """SCHEMAS as a table of literals."""
    rows = ", ".join(f"('{tool}', '{param}', '{kind}', {str(required).lower()})" for tool, param, kind, required in SCHEMAS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(tool, param, type, required)")


def tool_calls(conversations: DataFrame) -> DataFrame:
    """`link` over the calls that the turns of `conversations` stand for."""
    spark = conversations.sparkSession
    return link(*calls_of(conversations), schema_table(spark))


SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, length(coalesce(text, '')) AS n FROM conversations),
c AS (SELECT conv_id, turn, text, n, conv_id || '-' || turn AS call_id,
    CASE WHEN n % 17 = 0 THEN 'guess' ELSE ['search', 'count', 'translate'][n % 3 + 1] END AS name,
    conv_id || '-' || (turn - 2) AS before, CASE WHEN n % 5 = 0 THEN conv_id || '-' || (turn + 2) END AS after
  FROM t WHERE role = 'user'),
r AS (SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS call_id, text AS content, true AS answered FROM t WHERE role = 'assistant'),
need AS (SELECT c.call_id, d.call_id AS need FROM c JOIN c d ON d.call_id = c.before OR d.call_id = c.after),
walk AS (SELECT call_id, 0 AS level FROM c
  UNION SELECT need.call_id, walk.level + 1 FROM walk JOIN need ON need.need = walk.call_id WHERE walk.level < 20),
high AS (SELECT call_id, max(level) AS level FROM walk GROUP BY 1),
x AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, call_id, c.name,
    CASE WHEN high.level < 20 THEN high.level END AS level, n, text, content, answered,
    n % 13 = 0 AS broken, CASE WHEN name = 'guess' THEN '' ELSE concat_ws(',',
      CASE WHEN n % 7 = 0 THEN CASE WHEN n % 3 = 0 THEN 'missing query' ELSE 'missing text' END END,
      CASE WHEN n % 3 = 0 AND n % 11 = 0 THEN 'type limit' END) END AS wrong
  FROM c FULL JOIN r USING (call_id) LEFT JOIN high USING (call_id)),
y AS (SELECT *, CASE WHEN broken OR name IS NULL THEN '' WHEN name = 'guess' THEN
      concat_ws(',', CASE WHEN n % 3 = 0 THEN 'unknown limit' END,
        CASE WHEN n % 7 <> 0 THEN CASE WHEN n % 3 = 0 THEN 'unknown query' ELSE 'unknown text' END END,
        CASE WHEN n % 3 = 2 THEN 'unknown to' END) ELSE wrong END AS errors FROM x),
z AS (SELECT *, CASE WHEN name IS NULL THEN 'orphan result' WHEN name = 'guess' THEN 'unknown tool' WHEN broken THEN 'bad json'
    WHEN errors <> '' THEN 'invalid arguments' WHEN level IS NULL THEN 'circle' WHEN answered IS NULL THEN 'no result' ELSE 'ok' END AS status,
  CASE WHEN name IS NULL OR broken THEN 'null' WHEN n % 3 = 0 THEN
      '{"limit":' || CASE WHEN n % 11 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END || CASE WHEN n % 7 <> 0 THEN ',"query":' || to_json(text) ELSE '' END || '}'
    WHEN n % 3 = 1 THEN '{' || CASE WHEN n % 7 <> 0 THEN '"text":' || to_json(text) ELSE '' END || '}'
    ELSE '{' || CASE WHEN n % 7 <> 0 THEN '"text":' || to_json(text) || ',' ELSE '' END || '"to":"en"}' END AS arguments FROM y)
SELECT conv_id, turn, call_id, name, level, status, errors, 0 AS repeats,
  '{"arguments":' || arguments || ',"errors":' || to_json(string_split(nullif(errors, ''), ',')).coalesce('[]') || ',"id":' || to_json(call_id)
  || ',"level":' || coalesce(level::VARCHAR, 'null') || ',"name":' || coalesce(to_json(name), 'null')
  || ',"result":' || coalesce(to_json(content), 'null') || ',"status":' || to_json(status) || '}' AS line FROM z
"""
