"""Command-protocol queries over the ``events`` table.

Binding: every event is a command line
``event_type -n event_id "user <user_id>" k`` (k from ``props``); the session
key is ``user_id`` and the order is ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.asof import asof_latest
from ..sources.commands import events_as_commands, parse_commands
from ..sources.tables import table
from ..streaming.routes import command_rules, validate_commands
from ..streaming.settings import settings_state
from .registry import query, sql_str

# Minimum argument counts bound to the event types (the editor's own command
# names never occur in this table; ``error`` has no rule and is unknown).
EVENT_COMMAND_RULES = [("click", 1), ("view", 2), ("purchase", 3), ("signup", 1)]


def _commands(spark, sf_dir):
    return parse_commands(events_as_commands(table(spark, sf_dir, "events")))


# ---------------------------------------------------------------- oracle CTE
_UNESC = ("CASE WHEN length(u) = 2 AND starts_with(u, chr(92)) THEN "
          "CASE substr(u, 2, 1) WHEN 'n' THEN chr(10) WHEN 't' THEN chr(9) "
          "WHEN 'r' THEN chr(13) WHEN 'b' THEN chr(8) ELSE substr(u, 2, 1) END ELSE u END")
CMDS_CTE = f"""
lines AS (
  SELECT event_id, user_id, event_type,
         coalesce(json_extract_string(props, '$.k'), '') AS k,
         event_type || ' -n ' || CAST(event_id AS VARCHAR) || ' "user '
           || CAST(user_id AS VARCHAR) || '" '
           || coalesce(json_extract_string(props, '$.k'), '') AS line
  FROM events),
w AS (
  SELECT *, list_transform(regexp_extract_all(line, {sql_str(T.WORD_RX)}),
              lambda x: array_to_string(list_transform(
                 regexp_extract_all(x, {sql_str(T.UNIT_RX)}), lambda u: {_UNESC}), '')) AS words
  FROM lines),
c AS (SELECT *, words[2:] AS rest FROM w),
cmds AS (
  SELECT event_id, user_id, event_type, k, words[1] AS name,
         CAST(CASE WHEN len(rest) > 2 AND rest[1] = '-n'
              THEN CASE WHEN regexp_full_match(rest[2], '[+-]?[0-9]+')
                        THEN coalesce(TRY_CAST(rest[2] AS BIGINT), 0) ELSE 0 END
              ELSE 0 END AS BIGINT) AS no,
         CASE WHEN len(rest) > 2 AND rest[1] = '-n' THEN rest[3:] ELSE rest END AS args
  FROM c),
rendered AS (
  SELECT *, CASE WHEN no <> 0 THEN name || ' -n ' || CAST(no AS VARCHAR) || ' ' || array_to_string(args, ' ')
                 ELSE name || ' ' || array_to_string(args, ' ') END AS repr
  FROM cmds)
"""


# ------------------------------------------------------------ command_parse
@query("command_parse", sql=f"""
WITH {CMDS_CTE}
SELECT event_id, no, name, CAST(len(args) AS BIGINT) AS n_args,
       array_to_string(args, '|') AS args
FROM cmds
""")
def command_parse(spark, sf_dir):
    """S4 + F1 + F2: parse every command line."""
    c = _commands(spark, sf_dir)
    return c.select("event_id", "no", "name", F.size("args").cast("bigint").alias("n_args"),
                    F.array_join("args", "|").alias("args"))


# ----------------------------------------------------------- command_render
@query("command_render", sql=f"""
WITH {CMDS_CTE}
SELECT event_id, repr FROM rendered
""")
def command_render(spark, sf_dir):
    """render the parsed command back to a line."""
    c = _commands(spark, sf_dir)
    return c.select("event_id", T.render_command(F.col("no"), F.col("name"),
                                                 F.col("args")).alias("repr"))


# --------------------------------------------------------- command_validate
_RULES_SQL = ", ".join(f"('{n}', {m})" for n, m in EVENT_COMMAND_RULES)


@query("command_validate", sql=f"""
WITH {CMDS_CTE},
rules(name, min_args) AS (VALUES {_RULES_SQL})
SELECT r.event_id, r.name,
       CASE WHEN ru.min_args IS NULL THEN 'unknown'
            WHEN len(r.args) < ru.min_args THEN 'too_few' ELSE 'ok' END AS status,
       CASE WHEN ru.min_args IS NULL THEN '<UnknownCommand: ' || r.repr || '>'
            WHEN len(r.args) < ru.min_args
              THEN 'min ' || CAST(ru.min_args AS VARCHAR) || ' args required in cmd "' || r.repr || '"'
            ELSE NULL END AS msg
FROM rendered r LEFT JOIN rules ru ON r.name = ru.name
""")
def command_validate(spark, sf_dir):
    """Argument-count check against a broadcast rule table."""
    c = _commands(spark, sf_dir)
    v = validate_commands(c, command_rules(spark, EVENT_COMMAND_RULES))
    return v.select("event_id", "name", "status", "msg")


# ----------------------------------------------------------- command_routes
@query("command_routes", sql=f"""
WITH {CMDS_CTE}
SELECT name, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(DISTINCT args[1]) AS BIGINT) AS n_users
FROM cmds GROUP BY name
""")
def command_routes(spark, sf_dir):
    """T4 (batch form): rows and distinct sessions per route."""
    c = _commands(spark, sf_dir)
    return c.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.countDistinct(F.element_at("args", 1)).alias("n_users"))


# --------------------------------------------------------------- expand_vars
TEMPLATE = "$USER/${K}/$NONE"


@query("expand_vars", sql="""
SELECT event_id,
       CAST(user_id AS VARCHAR) || '/' || coalesce(json_extract_string(props, '$.k'), '') || '/'
         AS expanded
FROM events
""")
def expand_vars(spark, sf_dir):
    """expand a template with per-row settings USER and K."""
    c = events_as_commands(table(spark, sf_dir, "events"))
    m = F.create_map(F.lit("USER"), F.col("user_id").cast("string"), F.lit("K"), F.col("k"))
    return c.select("event_id", T.expand_vars(F.lit(TEMPLATE), m).alias("expanded"))


# ------------------------------------------------------------ settings_state
@query("settings_state", sql="""
WITH s AS (
  SELECT user_id, event_id,
         CASE WHEN event_type = 'signup'
              THEN coalesce(json_extract_string(props, '$.k'), '') END AS value
  FROM events WHERE event_type IN ('signup', 'error')),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM s)
SELECT user_id, value, event_id AS seq FROM r WHERE rn = 1
""")
def settings_state_q(spark, sf_dir):
    """Per user, ``signup`` sets the value k, ``error`` clears it."""
    c = events_as_commands(table(spark, sf_dir, "events")).filter(
        F.col("event_type").isin("signup", "error"))
    writes = c.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"),
                      F.when(F.col("event_type") == "signup", F.col("k")).alias("value"))
    return settings_state(writes).withColumnRenamed("key", "user_id")


# --------------------------------------------------------------- asof_latest
@query("asof_latest", sql="""
WITH e AS (
  SELECT event_id, user_id, event_type,
         coalesce(json_extract_string(props, '$.k'), '') AS k,
         last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
           OVER (PARTITION BY user_id ORDER BY event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS signup_id
  FROM events)
SELECT p.event_id, p.user_id, p.signup_id, s.k AS signup_k
FROM e p LEFT JOIN e s ON s.event_id = p.signup_id
WHERE p.event_type = 'purchase'
""")
def asof_latest_q(spark, sf_dir):
    """For each purchase, the latest earlier signup of the same user."""
    c = events_as_commands(table(spark, sf_dir, "events"))
    out = asof_latest(c, "user_id", "event_id", F.col("event_type") == "signup",
                      F.col("event_type") == "purchase", ["k"])
    return out.select("event_id", "user_id", F.col("match.event_id").alias("signup_id"),
                      F.col("match.k").alias("signup_k"))
