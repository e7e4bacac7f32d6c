"""Tool-call linking for chat data: join calls to results, order them, check arguments, write canonical JSON.

Calls are (conv_id, call_id, turn, name, arguments, depends_on), results (conv_id, call_id, turn, content), schemas
(name, field, type, required). Calls and results meet in a hash join on both ids; calls are ordered so that each comes
after those it depends on: its level is one more than the highest level of these, found by halving chains and then in
rounds, and calls of one level go by turn and id. Arguments are parsed once and compared with the schema of the call's
name. The JSON has sorted keys at every depth and no white space.

Ordering works on ids and turns alone; texts are shuffled once, by both ids. Nothing gathers a conversation in one
task: positions come from counts by conversation, level and block of turns, and a rank inside the block.

A schema's field is a key of the arguments, or a path of keys joined by dots. Its type is STRING, BIGINT (whole
numbers), DOUBLE (any number), BOOLEAN, OBJECT, ARRAY, or the full type of a value such as ARRAY<BIGINT>. A JSON null
has no type of these. Keys at the top that no field begins with are unknown.

Of calls with the same ids the one of the least turn (then name, then hash of the arguments) counts; of results the one
of the least turn (then content), and n_results has their number. Status: `ok`, `no_result`, or `cycle` (the call
depends, through others, on itself; level null, and last in order). Dependencies on calls that do not exist are
ignored. Results without a call are returned with status `orphan` and no position. Invalid, null or non-object
arguments fail validation; so do calls of unknown names. Rows with a null id are dropped; null turns come first. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rounds, counted, let, sized, stored, words_of

TURN_BLOCK = 256
SCHEMA_COLUMNS = "name string, field string, type string, required boolean"
KEY = ["conv_id", "call_id"]


def hashed(side: DataFrame) -> DataFrame:
    """The side of a join that is built into hash tables, partition by partition: its keys are distinct."""
    return side.hint("shuffle_hash")


def chain_anchors(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, anchor, steps): for calls with one need, the first call up the chain that has none or several.

    Each round doubles the reach of every pointer, so rounds grow with the logarithm of the longest chain; calls that
    still point into a chain after all rounds run in a circle and are left out.
    """
    chain, n = counted(single.select(*KEY, F.col("needs").alias("anchor"), F.lit(1).cast("bigint").alias("steps"), F.lit(True).alias("moves")), "chain")
    left = n
    for _ in range(n.bit_length() + 1):
        if not left:
            break
        ahead = chain.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"), F.col("moves").alias("on"))
        joined = chain.where("moves").join(hashed(ahead), ["conv_id", "anchor"], "left")
        # A pointer to a call outside the chains has arrived; so has one that takes over from a pointer that had.
        moved = joined.select(*KEY, F.coalesce("next", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("on", F.lit(False)).alias("moves"))
        chain = stored(chain.where("not moves").unionByName(moved), "chain")
        left = chain.where("moves").count()
    return chain.where("not moves").drop("moves")


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every call that depends on no cycle; calls have distinct ids.

    Chains of calls with one need each, however long, are first cut down to their ends. Among the rest a call becomes
    ready in the round after the last of its needs; rounds are as many as calls with several needs follow one another,
    and end when one makes no call ready.
    """
    ids = calls.select(*KEY)
    asked = calls.select(*KEY, F.explode(F.array_distinct("depends_on")).alias("needs"))
    deps = asked.join(hashed(ids.select("conv_id", F.col("call_id").alias("needs"))), ["conv_id", "needs"])
    deps = stored(deps, "deps")
    grouped = deps.groupBy(*KEY).agg(F.min("needs").alias("needs"), F.count("*").alias("n_needs"))
    grouped = stored(grouped, "needs")
    anchors = chain_anchors(grouped.where("n_needs = 1"))
    levels = ids.join(hashed(grouped.select(*KEY)), KEY, "left_anti").withColumn("level", F.lit(0).cast("bigint"))
    several, n_several = counted(grouped.where("n_needs > 1").select(*KEY, "n_needs"), "several")
    if n_several:
        levels = joined_levels(stored(levels, "levels"), deps.join(hashed(several), KEY), anchors)
    ends = levels.select("conv_id", F.col("call_id").alias("anchor"), "level")
    chained = anchors.join(hashed(ends), ["conv_id", "anchor"]).select(*KEY, (F.col("level") + F.col("steps")).alias("level"))
    return levels.unionByName(chained).select(*KEY, F.col("level").cast("int").alias("level"))


def joined_levels(levels: DataFrame, joins: DataFrame, anchors: DataFrame) -> DataFrame:
    """levels with those of calls that have several needs: a row of joins (conv_id, call_id, n_needs, needs) for each."""
    # Needs in the middle of chains are replaced by the chains' ends; needs in circles never become ready.
    anchor_of = anchors.select("conv_id", F.col("call_id").alias("needs"), "anchor", "steps")
    joins = joins.join(hashed(anchor_of), ["conv_id", "needs"], "left")
    joins, left = counted(joins.select(*KEY, "n_needs", F.coalesce("anchor", "needs").alias("needs"), F.coalesce("steps", F.lit(0)).alias("steps")), "joins")
    found, met, number, done = Rounds(levels.sparkSession, "levels"), Rounds(levels.sparkSession, "met"), 0, 0
    new, seen = found.add(levels.select(*KEY, F.lit(0).cast("bigint").alias("n_needs"), "level"), 0)
    n = seen["n"]
    while n:
        # A need is met in the round after its call got a level, once; only such rows and new levels are written.
        number += 1
        known = new.select("conv_id", F.col("call_id").alias("needs"), "level")
        arrived = joins.join(hashed(known), ["conv_id", "needs"]).groupBy(*KEY, "n_needs")
        met.add(arrived.agg(F.count("*").alias("n"), (F.max(F.col("level") + F.col("steps")) + 1).alias("level")), number)
        totals = met.all().groupBy(*KEY, "n_needs").agg(F.sum("n").alias("n"), F.max("level").alias("level"), F.max("round").alias("at"))
        ready = totals.where((F.col("n") == F.col("n_needs")) & (F.col("at") == number)).select(*KEY, "n_needs", "level")
        new, seen = found.add(ready, number, n=F.count(F.lit(1)), needs=F.sum("n_needs"))
        n, done = seen["n"], done + (seen["needs"] or 0)
        if n and 2 * done > left:
            # Calls that are ready leave the rest, which rounds read, when they are over half of it: few rows in sum.
            ends = hashed(found.all().select(*KEY))
            joins, left = counted(joins.join(ends, KEY, "left_anti"), "joins")
            waiting, done = Rounds(levels.sparkSession, "met"), 0
            waiting.add(totals.where("n < n_needs").select(*KEY, "n_needs", "n", "level"), number)
            met = waiting
    return found.all().select(*KEY, "level")


def is_type(given: Column, wanted: Column) -> Column:
    """Whether the type of a variant is one that a schema asks for."""
    whole = given.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    number = given.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return (
        F.when(wanted == "BIGINT", whole)
        .when(wanted == "DOUBLE", number)
        .when(wanted.isin("OBJECT", "ARRAY"), F.startswith(given, F.concat(wanted, F.lit("<"))))
        .otherwise(given == wanted)
    )


def argument_errors(parsed: Column, fields: Column) -> Column:
    """What is wrong with arguments (a variant) by the schema's fields: sorted messages."""
    keys = F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>"))
    typed = F.transform(fields, lambda f: F.struct(f.alias("f"), F.schema_of_variant(F.try_variant_get(parsed, F.concat(F.lit("$."), f["field"]), "variant")).alias("given")))

    def against(given: Column) -> Column:
        missing = F.transform(F.filter(given, lambda x: x["f"]["required"] & x["given"].isNull()), lambda x: F.concat(F.lit("missing "), x["f"]["field"]))
        wrong = F.transform(F.filter(given, lambda x: ~is_type(x["given"], x["f"]["type"])), lambda x: F.concat(F.lit("type of "), x["f"]["field"]))
        tops = F.transform(fields, lambda f: F.substring_index(f["field"], ".", 1))
        unknown = F.transform(F.array_except(keys, tops), lambda k: F.concat(F.lit("unknown "), k))
        return F.array_sort(F.concat(missing, unknown, wrong))

    bad = F.array(F.lit("not an object"))
    return F.when(fields.isNull(), F.array(F.lit("unknown name"))).when(keys.isNull(), bad).otherwise(let(typed, against))


def positions(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, seq) of calls (conv_id, call_id, turn, depends_on) with distinct ids."""
    ordered = calls.select(*KEY, "turn").join(hashed(call_levels(calls)), KEY, "left")
    ordered = stored(ordered.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / TURN_BLOCK)), "ordered")
    counts = ordered.groupBy("conv_id", "level", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("level").asc_nulls_last(), "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("_conv"), F.col("level").alias("_level"), F.col("block").alias("_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "level", "block").orderBy("turn", "call_id"))
    placed = ordered.withColumn("rank", rank)
    at = (placed["conv_id"] == F.col("_conv")) & placed["level"].eqNullSafe(F.col("_level")) & (placed["block"] == F.col("_block"))
    return placed.join(hashed(counts), at).select(*KEY, "level", (F.col("offset") + F.col("rank") - 1).cast("long").alias("seq"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Returns conv_id, call_id, turn, name, level, seq, n_results, status, valid, errors, json."""
    some = "conv_id is not null and call_id is not null"
    needs = F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")
    calls = calls.where(some).select(*KEY, "turn", "name", "arguments", F.xxhash64(F.coalesce("arguments", F.lit(""))).alias("hash"), needs)
    narrow = calls.groupBy(*KEY).agg(F.min(F.struct("turn", "name", "hash", "depends_on")).alias("c")).select(*KEY, "c.turn", "c.depends_on")
    placed = positions(stored(narrow, "calls"))
    whole = calls.groupBy(*KEY).agg(F.min(F.struct("turn", "name", "hash", "depends_on", "arguments")).alias("c")).select(*KEY, "c.turn", "c.name", "c.arguments")
    answers = results.where(some).groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    answers = answers.select(*KEY, F.col("r.content").alias("content"), "n_results", F.lit(True).alias("answered"))
    fields = schemas.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("field", "type", "required"))).alias("fields"))
    linked = whole.join(hashed(placed), KEY).join(hashed(answers), KEY, "full").join(sized(fields, "schemas"), "name", "left")
    linked = linked.withColumn("_args", F.try_parse_json(F.coalesce("arguments", F.lit("null"))))
    errors = F.when(F.col("seq").isNotNull(), argument_errors(F.col("_args"), F.col("fields")))
    status = F.when(F.col("seq").isNull(), "orphan").when(F.col("level").isNull(), "cycle").when(F.col("answered").isNull(), "no_result").otherwise("ok")
    linked = linked.withColumn("status", status).withColumn("errors", errors)
    quoted = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(c))), F.lit("[null]"))
    bare = lambda c: F.regexp_replace(quoted(c), r"^\[|\]$", "")
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("_args"), F.lit("null")),
        F.lit(',"id":'), bare(F.col("call_id")),
        F.lit(',"name":'), bare(F.col("name")),
        F.lit(',"result":'), bare(F.col("content")),
        F.lit(',"status":'), bare(F.col("status")),
        F.lit("}"),
    )
    return linked.select(
        "conv_id",
        "call_id",
        "turn",
        "name",
        "level",
        "seq",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        "status",
        F.coalesce(F.size("errors") == 0, F.lit(False)).alias("valid"),
        F.array_join("errors", "; ").alias("errors"),
        json.alias("json"),
    )


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas of plain conversations: what a user says asks the assistant for a reply.

    A user's turn is a call of `reply` that depends on the user's turn before, the assistant's next turn its result; a
    system turn is a call of `configure`.
    """
    spark: SparkSession = conversations.sparkSession
    id_at = lambda turn: F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")))
    turn, n_words = F.col("turn"), F.size(words_of(F.col("text")))
    asks = F.to_json(F.struct(n_words.alias("words"), turn.alias("turn"), F.col("text").alias("prompt")), {"ignoreNullFields": "false"})
    sets = F.to_json(F.struct(F.col("text").alias("policy")), {"ignoreNullFields": "false"})
    user = F.col("role") == "user"
    calls = conversations.where(F.col("role").isin("user", "system")).select(
        "conv_id",
        id_at(turn).alias("call_id"),
        "turn",
        F.when(user, "reply").otherwise("configure").alias("name"),
        F.when(user, asks).otherwise(sets).alias("arguments"),
        F.when(user, F.array(id_at(turn - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = conversations.where("role = 'assistant'").select("conv_id", id_at(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    fields = [("reply", "prompt", "STRING", True), ("reply", "turn", "BIGINT", True), ("reply", "words", "BIGINT", True), ("configure", "policy", "STRING", True), ("configure", "mode", "STRING", False)]
    return calls, results, spark.createDataFrame(fields, SCHEMA_COLUMNS)


ORACLE_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, md5(concat_ws(':', conv_id, turn)) AS call_id, turn, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name,
         CASE role WHEN 'user' THEN json_object('prompt', text, 'turn', turn, 'words', len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))
              ELSE json_object('policy', text) END AS arguments,
         CASE role WHEN 'user' THEN md5(concat_ws(':', conv_id, turn - 2)) END AS needs, text IS NULL AS no_text
  FROM conversations WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, md5(concat_ws(':', conv_id, turn - 1)) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
l AS (
  SELECT conv_id, call_id, 0 AS level FROM c WHERE needs IS NULL OR NOT EXISTS (SELECT 1 FROM c d WHERE d.conv_id = c.conv_id AND d.call_id = c.needs)
  UNION ALL
  SELECT c.conv_id, c.call_id, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.needs = l.call_id),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, turn, name, level, arguments, content, no_text,
         CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'ok' END AS status
  FROM c JOIN l USING (conv_id, call_id) FULL JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.call_id)
SELECT conv_id, call_id, turn, name, level,
       CASE WHEN status <> 'orphan' THEN row_number() OVER (PARTITION BY conv_id, status = 'orphan' ORDER BY level, turn, call_id) - 1 END AS seq,
       (status <> 'no_result')::BIGINT AS n_results, status, status <> 'orphan' AND NOT no_text AS valid,
       CASE WHEN status = 'orphan' THEN NULL WHEN no_text THEN 'type of ' || CASE name WHEN 'reply' THEN 'prompt' ELSE 'policy' END ELSE '' END AS errors,
       json_object('arguments', arguments, 'id', call_id, 'name', name, 'result', content, 'status', status)::VARCHAR AS json
FROM j
"""
