"""The given tables in the roles of the session tables, once for Spark and once as SQL.

``lineitem``/``part`` play API messages, ``events`` plays tool calls, prompts
and a second message stream, ``orders`` plays the session list,
``conversations`` and ``documents`` play searchable text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import ntz_ms

SPARK: dict[str, Callable] = {}
SQL: dict[str, tuple[str, str]] = {}  # name -> (names it needs, query)


def role(name: str, sql: str, needs: str = ""):
    def add(fn):
        SPARK[name] = fn
        SQL[name] = (needs, sql)
        return fn

    return add


def with_views(names: list[str], sql: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for need in SQL[n][0].split():
            visit(need)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    views = ",\n".join(f"{n} AS ({SQL[n][1]})" for n in order)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if recursive:
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all cores. Each given table is one file with one row group,
    which one task reads; real transcripts come in many splits and need no such step."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


@role(
    "pricing",
    """
    SELECT model, valid_from, r AS input_rate, r * 5 AS output_rate,
           CASE WHEN b % 3 = 0 THEN r * 1.5 END AS cache_write_rate,
           CASE WHEN b % 2 = 0 THEN r * 0.2 END AS cache_read_rate,
           CASE WHEN b % 4 = 0 THEN r * 2 END AS input_rate_200k,
           CASE WHEN b % 4 = 0 THEN r * 10 END AS output_rate_200k,
           CAST(NULL AS DOUBLE) AS cache_write_rate_200k,
           CASE WHEN b % 4 = 0 THEN r * 0.4 END AS cache_read_rate_200k,
           CASE WHEN b % 6 = 0 THEN r * 3 END AS cache_write_1h_rate
    FROM (
      SELECT 'brand#' || b AS model, b, CASE WHEN b % 5 = 0 THEN DATE '1997-01-01' END AS valid_from,
             b * 1e-6 AS r FROM range(1, 20) t(b)
      UNION ALL
      SELECT 'brand#' || b, b, DATE '1999-01-01', b * 2e-6 FROM range(2, 20, 2) t(b)
    ) x
    """,
)
def pricing(t) -> DataFrame:
    """A price history: later entries for even models, late starts for every fifth."""
    base = t.spark.range(1, 20).select(F.col("id").alias("b")).select(
        "b",
        F.when(F.col("b") % 5 == 0, F.lit("1997-01-01").cast("date")).alias("valid_from"),
        (F.col("b") * 1e-6).alias("r"),
    )
    later = t.spark.range(2, 20, 2).select(
        F.col("id").alias("b"), F.lit("1999-01-01").cast("date").alias("valid_from"), (F.col("id") * 2e-6).alias("r")
    )
    b, r = F.col("b"), F.col("r")
    return base.union(later).select(
        F.concat(F.lit("brand#"), b.cast("string")).alias("model"),
        "valid_from",
        r.alias("input_rate"),
        (r * 5).alias("output_rate"),
        F.when(b % 3 == 0, r * 1.5).alias("cache_write_rate"),
        F.when(b % 2 == 0, r * 0.2).alias("cache_read_rate"),
        F.when(b % 4 == 0, r * 2).alias("input_rate_200k"),
        F.when(b % 4 == 0, r * 10).alias("output_rate_200k"),
        F.lit(None).cast("double").alias("cache_write_rate_200k"),
        F.when(b % 4 == 0, r * 0.4).alias("cache_read_rate_200k"),
        F.when(b % 6 == 0, r * 3).alias("cache_write_1h_rate"),
    )


# Model ids in the four forms a price key is found by.
MODEL_SQL = """
    CASE {form} % 4 WHEN 0 THEN lower({brand}) WHEN 1 THEN lower({brand}) || '-20240115'
         WHEN 2 THEN 'us.anthropic.' || lower({brand}) || '-v1:0' ELSE lower({brand}) || '-preview' END
"""


def _model(form, brand):
    low = F.lower(brand)
    return (
        F.when(form % 4 == 0, low)
        .when(form % 4 == 1, F.concat(low, F.lit("-20240115")))
        .when(form % 4 == 2, F.concat(F.lit("us.anthropic."), low, F.lit("-v1:0")))
        .otherwise(F.concat(low, F.lit("-preview")))
    )


@role(
    "snapshots",
    f"""
    SELECT 's' || l_orderkey AS session,
           CASE WHEN l_linenumber <= 4 THEN 'main' ELSE 'a' || (l_suppkey % 5) END AS thread,
           l_linenumber * 100000000000000000 + l_partkey % 1000000 * 100000000000 + l_suppkey % 1000 * 100000000
             + CAST(round(l_extendedprice * 100) AS BIGINT) AS line,
           'm' || l_orderkey || '-' || (l_linenumber // 2) AS message_id,
           {MODEL_SQL.format(form='p_size', brand='p_brand')} AS model,
           epoch_us(l_shipdate) // 1000 AS ts_ms,
           NOT (l_returnflag = 'A' AND l_linenumber = 3) AS has_usage,
           CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 100 END AS input_tokens,
           CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 10 END AS output_tokens,
           CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) * 2 END AS cache_read_tokens,
           CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(round(l_discount * 100) AS BIGINT) * 1000 END AS cache_write_tokens,
           CASE WHEN l_returnflag = 'R' THEN CAST(round(l_discount * 100) AS BIGINT) * 400 END AS cache_write_5m_tokens,
           CASE WHEN l_returnflag = 'R' THEN CAST(round(l_discount * 100) AS BIGINT) * 600 END AS cache_write_1h_tokens
    FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
)
def snapshots(t) -> DataFrame:
    """Streaming snapshots of API messages: several lines may carry one message."""
    li = t.raw("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_returnflag", "l_shipdate",
    )
    pa = t.raw("part").select("p_partkey", "p_brand", "p_size")
    c = F.col
    tokens = lambda x: F.when(c("l_linenumber") == 7, F.lit(0)).otherwise(x).cast("bigint")
    hundredths = F.round(c("l_discount") * 100).cast("bigint")
    returned = c("l_returnflag") == "R"
    return li.join(pa, c("l_partkey") == c("p_partkey")).select(
        F.concat(F.lit("s"), c("l_orderkey").cast("string")).alias("session"),
        F.when(c("l_linenumber") <= 4, F.lit("main"))
        .otherwise(F.concat(F.lit("a"), (c("l_suppkey") % 5).cast("string"))).alias("thread"),
        (c("l_linenumber").cast("bigint") * 100000000000000000 + c("l_partkey") % 1000000 * 100000000000 + c("l_suppkey") % 1000 * 100000000
         + F.round(c("l_extendedprice") * 100).cast("bigint")).alias("line"),
        F.concat(
            F.lit("m"), c("l_orderkey").cast("string"), F.lit("-"),
            F.floor(c("l_linenumber") / 2).cast("string"),
        ).alias("message_id"),
        _model(c("p_size"), c("p_brand")).alias("model"),
        ntz_ms(c("l_shipdate")).alias("ts_ms"),
        (~((c("l_returnflag") == "A") & (c("l_linenumber") == 3))).alias("has_usage"),
        tokens(c("l_quantity").cast("bigint") * 100).alias("input_tokens"),
        tokens(c("l_quantity").cast("bigint") * 10).alias("output_tokens"),
        tokens(F.floor("l_extendedprice").cast("bigint") * 2).alias("cache_read_tokens"),
        tokens(hundredths * 1000).alias("cache_write_tokens"),
        F.when(returned, hundredths * 400).alias("cache_write_5m_tokens"),
        F.when(returned, hundredths * 600).alias("cache_write_1h_tokens"),
    )


# One message per (session, thread, message id): first line, model and time, last usage.
MESSAGES_SQL = """
    SELECT session, thread, message_id, min(line) AS line, arg_min(model, line) AS model,
           arg_min(ts_ms, line) AS ts_ms,
           arg_max(input_tokens, line) FILTER (has_usage) AS input_tokens,
           arg_max(output_tokens, line) FILTER (has_usage) AS output_tokens,
           arg_max(cache_read_tokens, line) FILTER (has_usage) AS cache_read_tokens,
           arg_max(cache_write_tokens, line) FILTER (has_usage) AS cache_write_tokens,
           (arg_max({'v': cache_write_5m_tokens}, line) FILTER (has_usage)).v AS cache_write_5m_tokens,
           (arg_max({'v': cache_write_1h_tokens}, line) FILTER (has_usage)).v AS cache_write_1h_tokens
    FROM snapshots GROUP BY session, thread, message_id
"""


@role("messages", MESSAGES_SQL, "snapshots")
def messages(t) -> DataFrame:
    from ..operators import usage

    return usage.dedupe_messages(t.snapshots)


PRICED_SQL = """
    SELECT m.*, input_rate, output_rate, cache_write_rate, cache_read_rate, input_rate_200k, output_rate_200k,
           cache_write_rate_200k, cache_read_rate_200k, cache_write_1h_rate,
           input_tokens + cache_read_tokens + cache_write_tokens > 200000 AS above,
           input_tokens + cache_read_tokens + cache_write_tokens + output_tokens = 0 AS zero
    FROM (SELECT x.*, k.price_key FROM {messages} x LEFT JOIN (
            SELECT model, arg_max(key, CASE WHEN key = plain THEN 1000000
                     WHEN key = regexp_replace(plain, '-[0-9]{{8}}$', '') THEN 500000 ELSE length(key) END) AS price_key
            FROM (SELECT DISTINCT model, CASE WHEN regexp_matches(model, '^(us\\.|eu\\.|apac\\.|global\\.)?anthropic\\.')
                    THEN regexp_replace(regexp_replace(model, '^(us\\.|eu\\.|apac\\.|global\\.)?anthropic\\.', ''), '-v[0-9]+:[0-9]+$', '')
                    ELSE model END AS plain FROM {messages}) d
            JOIN (SELECT DISTINCT model AS key FROM pricing) p ON starts_with(plain, key)
            GROUP BY model) k USING (model)) m
    LEFT JOIN (SELECT model AS pk, coalesce(valid_from, DATE '0001-01-01') AS vf,
                      lead(valid_from) OVER (PARTITION BY model ORDER BY valid_from NULLS FIRST) AS vu,
                      * EXCLUDE (model, valid_from) FROM pricing) r
      ON pk = price_key AND vf <= CAST(make_timestamp(ts_ms * 1000) AS DATE)
         AND (vu IS NULL OR CAST(make_timestamp(ts_ms * 1000) AS DATE) < vu)
"""
COST_SQL = """
    SELECT *, input_cost + output_cost + cache_read_cost + cache_write_cost AS cost FROM (
    SELECT * EXCLUDE (input_rate, output_rate, cache_write_rate, cache_read_rate, input_rate_200k, output_rate_200k,
                      cache_write_rate_200k, cache_read_rate_200k, cache_write_1h_rate, above, zero),
      CASE WHEN zero THEN 0.0 WHEN input_rate IS NOT NULL THEN
        input_tokens * coalesce(CASE WHEN above THEN input_rate_200k END, input_rate) END AS input_cost,
      CASE WHEN zero THEN 0.0 WHEN input_rate IS NOT NULL THEN
        output_tokens * coalesce(CASE WHEN above THEN output_rate_200k END, output_rate) END AS output_cost,
      CASE WHEN zero THEN 0.0 WHEN input_rate IS NOT NULL THEN cache_read_tokens *
        coalesce(CASE WHEN above THEN cache_read_rate_200k END, cache_read_rate, input_rate * 0.1) END AS cache_read_cost,
      CASE WHEN zero THEN 0.0 WHEN input_rate IS NOT NULL THEN
        CASE WHEN cache_write_5m_tokens IS NOT NULL OR cache_write_1h_tokens IS NOT NULL
          THEN coalesce(cache_write_5m_tokens, 0) * coalesce(CASE WHEN above THEN cache_write_rate_200k END, cache_write_rate, input_rate * 1.25)
             + coalesce(cache_write_1h_tokens, 0) * coalesce(cache_write_1h_rate, input_rate * 2)
          ELSE cache_write_tokens * coalesce(CASE WHEN above THEN cache_write_rate_200k END, cache_write_rate, input_rate * 1.25)
        END END AS cache_write_cost
    FROM ({rated})) z
"""


def cost_sql(view: str) -> str:
    """Priced rows of a message view with all cost columns."""
    return COST_SQL.format(rated=PRICED_SQL.format(messages=view))


@role("costed", cost_sql("(SELECT * FROM messages WHERE input_tokens IS NOT NULL)"), "messages pricing")
def costed(t) -> DataFrame:
    """Messages with usage and their costs."""
    from ..operators import pricing as p

    return p.priced(t.messages.where("input_tokens IS NOT NULL"), t.pricing)


@role(
    "ev",
    """
    SELECT *, CASE WHEN k < 60 THEN 'main' ELSE 'a' || (k % 4) END AS thread,
      CASE WHEN k < 60 THEN 'brand#' || (1 + user_id % 25) WHEN k % 4 = 0 THEN 'brand#2'
           WHEN k % 4 = 1 THEN 'brand#5-preview' WHEN k % 4 = 2 THEN 'brand#22' END AS model
    FROM (SELECT 's' || user_id AS session, event_id + 1 AS line, epoch_us(ts) // 1000 AS ts_ms, event_id, user_id, event_type, value,
                 CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events) b
    """,
)
def ev(t) -> DataFrame:
    """Events with the numbers the other roles derive from."""
    k, main = F.col("k"), F.col("k") < 60
    base = t.raw("events").select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"),
        (F.col("event_id") + 1).alias("line"), ntz_ms(F.col("ts")).alias("ts_ms"),
        "event_id", "user_id", "event_type", "value",
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"),
    )
    return base.withColumns({
        "thread": F.when(main, F.lit("main")).otherwise(F.concat(F.lit("a"), (k % 4).cast("string"))),
        "model": F.when(main, F.concat(F.lit("brand#"), (1 + F.col("user_id") % 25).cast("string")))
        .when(k % 4 == 0, F.lit("brand#2")).when(k % 4 == 1, F.lit("brand#5-preview")).when(k % 4 == 2, F.lit("brand#22")),
    })


COMMAND_SQL = """CASE k % 10 WHEN 0 THEN 'cd /srv/app && git log --oneline -n ' || k
  WHEN 1 THEN 'cat /var/log/app' || k || '.log' WHEN 2 THEN 'FOO=bar time npm test "case ' || k || '"'
  WHEN 3 THEN 'echo "a; b" | grep -c foo' || k || ' | wc -l' WHEN 4 THEN 'sed -n ''10,20p'' src/f' || k || '.txt'
  WHEN 5 THEN 'for f in *.txt; do echo $f; done' WHEN 6 THEN 'ls *.md | xargs -n 1 docker ps'
  WHEN 7 THEN 'head -n 100 < in.txt > out.txt' WHEN 8 THEN 'python3 run.py --seed ' || event_id ELSE 'ls' END"""
SHAPE_SQL = """CASE k % 10 WHEN 0 THEN 'cd <PATH> && git log --oneline -n <NUM>'
  WHEN 1 THEN 'cat <PATH>' WHEN 2 THEN 'FOO=bar time npm test <STR>'
  WHEN 3 THEN 'echo <STR> | grep -c foo' || k || ' | wc -l' WHEN 4 THEN 'sed -n <STR> <PATH>'
  WHEN 5 THEN 'for f in *.txt; do echo $f; done' WHEN 6 THEN 'ls *.md | xargs -n <NUM> docker ps'
  WHEN 7 THEN 'head -n <NUM> < in.txt > out.txt' WHEN 8 THEN 'python3 run.py --seed <NUM>' ELSE 'ls' END"""
FAMILY_SQL = """CASE k % 10 WHEN 0 THEN 'git' WHEN 1 THEN 'cat' WHEN 2 THEN 'npm' WHEN 3 THEN 'grep' WHEN 4 THEN 'sed'
  WHEN 5 THEN '(unparsed)' WHEN 6 THEN 'ls' WHEN 7 THEN 'head' WHEN 8 THEN 'python3' ELSE 'ls' END"""


def _command():
    k, n = F.col("k"), F.col("k").cast("string")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    return (
        F.when(k % 10 == 0, cat("cd /srv/app && git log --oneline -n ", n))
        .when(k % 10 == 1, cat("cat /var/log/app", n, ".log"))
        .when(k % 10 == 2, cat('FOO=bar time npm test "case ', n, '"'))
        .when(k % 10 == 3, cat('echo "a; b" | grep -c foo', n, " | wc -l"))
        .when(k % 10 == 4, cat("sed -n '10,20p' src/f", n, ".txt"))
        .when(k % 10 == 5, F.lit("for f in *.txt; do echo $f; done"))
        .when(k % 10 == 6, F.lit("ls *.md | xargs -n 1 docker ps"))
        .when(k % 10 == 7, F.lit("head -n 100 < in.txt > out.txt"))
        .when(k % 10 == 8, cat("python3 run.py --seed ", F.col("event_id").cast("string")))
        .otherwise(F.lit("ls"))
    )


ERROR_TEXTS = [
    "Error: ENOENT no such file", "String to replace not found in file", "Permission denied",
    "Request interrupted by user", "Command timed out", "exit code 2", "odd failure",
]
TOOL_SQL = """CASE event_type WHEN 'view' THEN CASE WHEN k % 10 = 9 THEN 'Grep' ELSE 'Read' END WHEN 'purchase' THEN 'Edit'
  WHEN 'signup' THEN 'mcp__srv' || (k % 3) || '__query' ELSE 'Bash' END"""
INPUT_SQL = f"""CASE WHEN event_type IN ('purchase', 'view') AND NOT (event_type = 'view' AND k % 10 = 9)
    THEN '{{"file_path":"/repo/d' || (k % 7) || '/f' || (k % 13) || '.py"}}'
  WHEN event_type = 'view' THEN '{{"pattern":"p' || k || '"}}' WHEN event_type = 'signup' THEN '{{"query":"q' || k || '"}}'
  ELSE '{{"command":"' || replace({COMMAND_SQL}, '"', '\\"') || '"}}' END"""
ERRTEXT_SQL = "CASE k % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ERROR_TEXTS)) + " END"


@role(
    "calls",
    f"""
    SELECT session, thread, line, 't' || event_id AS call_id, {TOOL_SQL} AS tool, {INPUT_SQL} AS input, ts_ms, model,
      k % 23 <> 0 AS has_result,
      CASE WHEN k % 23 <> 0 THEN event_type = 'error' END AS is_error,
      CASE WHEN k % 23 <> 0 THEN CASE WHEN event_type = 'error' THEN {ERRTEXT_SQL} ELSE 'ok ' || k END END AS result_text,
      CASE WHEN k % 23 <> 0 THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END AS result_chars,
      CASE WHEN k % 23 <> 0 THEN ts_ms + k * 1000 END AS result_ts_ms,
      CASE WHEN k % 23 <> 0 THEN line + 1 END AS result_line,
      k % 29 = 0 AS placeholder, k, event_id
    FROM ev
    """,
    "ev",
)
def calls(t) -> DataFrame:
    """Tool calls joined to their results."""
    k, et = F.col("k"), F.col("event_type")
    done = k % 23 != 0
    reads = (et == "view") & (k % 10 != 9)
    tool = (
        F.when(reads, F.lit("Read")).when(et == "view", F.lit("Grep")).when(et == "purchase", F.lit("Edit"))
        .when(et == "signup", F.concat(F.lit("mcp__srv"), (k % 3).cast("string"), F.lit("__query"))).otherwise(F.lit("Bash"))
    )
    path = F.concat(F.lit("/repo/d"), (k % 7).cast("string"), F.lit("/f"), (k % 13).cast("string"), F.lit(".py"))
    args = F.to_json(F.struct(
        F.when(reads | (et == "purchase"), path).alias("file_path"),
        F.when((et == "view") & ~reads, F.concat(F.lit("p"), k.cast("string"))).alias("pattern"),
        F.when(et == "signup", F.concat(F.lit("q"), k.cast("string"))).alias("query"),
        F.when(et.isin("click", "error"), _command()).alias("command"),
    ))
    err = F.get(F.array(*[F.lit(x) for x in ERROR_TEXTS]), (k % 7).cast("int"))
    return t.ev.select(
        "session", "thread", "line", F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("call_id"),
        tool.alias("tool"), args.alias("input"), "ts_ms", "model", done.alias("has_result"),
        F.when(done, et == "error").alias("is_error"),
        F.when(done, F.when(et == "error", err).otherwise(F.concat(F.lit("ok "), k.cast("string")))).alias("result_text"),
        F.when(done, F.floor(F.col("value") * 100)).otherwise(F.lit(0)).cast("bigint").alias("result_chars"),
        F.when(done, F.col("ts_ms") + k * 1000).alias("result_ts_ms"),
        F.when(done, F.col("line") + 1).alias("result_line"),
        (k % 29 == 0).alias("placeholder"), "k", "event_id",
    )


@role(
    "commands",
    f"""
    SELECT session, thread, line, call_id, model, {COMMAND_SQL} AS command, {SHAPE_SQL} AS shape, {FAMILY_SQL} AS family,
      CASE k % 10 WHEN 0 THEN 'log' WHEN 2 THEN 'test' END AS subcommand, k % 10 IN (1, 4) AS reads_file,
      coalesce(is_error, false) AS is_error, result_chars, placeholder, k,
      length({COMMAND_SQL}) AS input_chars
    FROM calls WHERE tool = 'Bash'
    """,
    "calls",
)
def commands(t) -> DataFrame:
    """Shell calls with their program and shape."""
    from ..functions import jsonx
    from ..operators import shell_usage

    raw = t.calls.where("tool = 'Bash'").select(
        "session", "thread", "line", "call_id", "model",
        jsonx.string_at(jsonx.parse(F.col("input")), "$.command").alias("command"),
        F.coalesce("is_error", F.lit(False)).alias("is_error"), "result_chars", "placeholder", "k",
    )
    return shell_usage.parsed_commands(raw)


INPUT_RATE_SQL = """(SELECT model, arg_max(input_rate, coalesce(valid_from, DATE '0001-01-01')) AS input_rate FROM pricing GROUP BY model)"""
# Every model here is its own price key or has one as longest prefix.
CALL_RATE_SQL = f"""
    SELECT d.model, arg_max(p.input_rate, length(p.model)) AS input_rate
    FROM (SELECT DISTINCT model FROM ev WHERE model IS NOT NULL) d JOIN {INPUT_RATE_SQL} p ON starts_with(d.model, p.model) GROUP BY d.model
"""


@role(
    "priced_commands",
    f"""SELECT c.*, CASE WHEN NOT placeholder THEN ceil(result_chars / 4.0) * input_rate END AS est_usd,
        ceil(result_chars / 4.0) * input_rate AS raw_usd
        FROM commands c LEFT JOIN ({CALL_RATE_SQL}) USING (model)""",
    "commands pricing",
)
def priced_commands(t) -> DataFrame:
    from ..operators import pricing as p

    return p.with_result_cost(t.commands, t.pricing)


@role(
    "priced_calls",
    f"""SELECT c.*, CASE WHEN NOT placeholder THEN ceil(result_chars / 4.0) * input_rate END AS est_usd
        FROM calls c LEFT JOIN ({CALL_RATE_SQL}) USING (model)""",
    "calls pricing",
)
def priced_calls(t) -> DataFrame:
    from ..operators import pricing as p

    return p.with_result_cost(t.calls, t.pricing)


@role(
    "evmessages",
    """
    SELECT session, thread, 'm' || event_id AS message_id, line, ts_ms, model, k * 10 AS input_tokens,
      CAST(floor(value) AS BIGINT) AS output_tokens, CAST(floor(value * 1000) AS BIGINT) AS cache_read_tokens,
      k * 5 AS cache_write_tokens, CAST(NULL AS BIGINT) AS cache_write_5m_tokens, CAST(NULL AS BIGINT) AS cache_write_1h_tokens
    FROM ev WHERE event_type IN ('view', 'click') AND k % 19 <> 0
    """,
    "ev",
)
def evmessages(t) -> DataFrame:
    """API messages with usage, in line order within a session."""
    return t.ev.where("event_type IN ('view', 'click') AND k % 19 <> 0").select(
        "session", "thread", F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"), "line", "ts_ms", "model",
        (F.col("k") * 10).alias("input_tokens"), F.floor("value").cast("bigint").alias("output_tokens"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("cache_read_tokens"), (F.col("k") * 5).alias("cache_write_tokens"),
        F.lit(None).cast("bigint").alias("cache_write_5m_tokens"), F.lit(None).cast("bigint").alias("cache_write_1h_tokens"),
    )


@role("evcosted", cost_sql("evmessages"), "evmessages pricing")
def evcosted(t) -> DataFrame:
    from ..operators import pricing as p

    return p.priced(t.evmessages, t.pricing)


@role(
    "prompts",
    "SELECT session, line, ts_ms, 'Prompt number ' || k AS text FROM ev WHERE event_type = 'signup' AND thread = 'main'",
    "ev",
)
def prompts(t) -> DataFrame:
    return t.ev.where("event_type = 'signup' AND thread = 'main'").select(
        "session", "line", "ts_ms", F.concat(F.lit("Prompt number "), F.col("k").cast("string")).alias("text")
    )


@role(
    "items",
    """
    SELECT 'o' || o_orderkey AS session, o_orderkey AS k, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'codex' ELSE 'claude-code' END AS source,
      CASE WHEN o_custkey % 7 <> 0 THEN '/repos/' || n_name END AS repo_root,
      CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'proj' || (o_custkey % 10) END AS project_dir,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 2 = 0 THEN 'https://git/x' || n_nationkey END AS repo_url,
      '/w/' || (o_custkey % 5) AS cwd,
      CASE WHEN o_orderkey % 97 <> 0 THEN epoch_us(o_orderdate) // 1000 + (o_orderkey * 7919 % 86400) * 1000 END AS started_ms,
      epoch_us(o_orderdate) // 1000 AS mtime_ms, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 100000 END AS duration_ms,
      o_orderkey % 9 AS user_turns, 'Prompt of session ' || o_orderkey || repeat(' and more', CAST(o_orderkey % 20 AS INTEGER)) AS first_prompt,
      o_totalprice / 1000 AS total_cost, o_orderstatus <> 'P' AS cost_is_complete, o_orderkey % 1000000 AS total_tokens,
      CASE o_orderstatus WHEN 'O' THEN o_totalprice / 1000 * 0.9 WHEN 'F' THEN o_totalprice / 1000 * 0.4 END AS main_cost,
      CASE o_orderstatus WHEN 'O' THEN o_totalprice / 1000 * 0.1 WHEN 'F' THEN o_totalprice / 1000 * 0.6 END AS sub_cost,
      o_orderkey % 700000 AS main_tokens, o_orderkey % 300000 AS sub_tokens, o_orderkey % 8 AS sub_messages, o_orderkey % 8 // 3 AS top_tier_messages,
      o_orderkey % 3 AS compactions, CASE WHEN o_orderkey % 4 = 0 THEN 1 + o_orderkey % 6 END AS returns,
      CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 60000 END AS return_chars, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey * 13 % 50000 END AS return_max_chars,
      o_orderkey % 13 AS bash_calls, o_orderkey * 31 % 50000 AS bash_chars, CASE WHEN o_custkey % 3 <> 0 THEN (o_orderkey * 17 % 9000) / 1000 END AS bash_usd,
      o_orderkey * 37 % 400000 AS max_context_tokens, o_orderkey % 8 AS subagents
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    """,
)
def items(t) -> DataFrame:
    """The session list; unknown costs for one order status."""
    c = F.col
    k, cust = c("o_orderkey"), c("o_custkey")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    is_b = c("o_orderpriority").isin("1-URGENT", "2-HIGH")
    cost = c("o_totalprice") / 1000
    ret = k % 4 == 0
    day_ms = ntz_ms(c("o_orderdate"))
    joined = (
        t.raw("orders").join(t.raw("customer").select("c_custkey", "c_nationkey"), cust == c("c_custkey"))
        .join(t.raw("nation").select("n_nationkey", "n_name"), c("c_nationkey") == c("n_nationkey"))
    )
    m = lambda name, inp, out, read, write, usd: F.struct(
        name.alias("model"), inp.cast("bigint").alias("input_tokens"), out.cast("bigint").alias("output_tokens"),
        read.cast("bigint").alias("cache_read_tokens"), write.cast("bigint").alias("cache_write_tokens"), usd.alias("cost"))
    zero = F.lit(0)
    one = m(cat("brand#", k % 5), k % 1000, k % 100, k % 5000, k % 300, F.when(k % 10 != 0, cost * 0.75))
    two = m(F.lit("opus-4"), k % 77, k % 55, zero, zero, cost * 0.25)
    return joined.select(
        cat("o", k).alias("session"), k.alias("k"), F.when(is_b, F.lit("codex")).otherwise(F.lit("claude-code")).alias("source"),
        F.when(cust % 7 != 0, cat("/repos/", c("n_name"))).alias("repo_root"), F.when(~is_b, cat("proj", cust % 10)).alias("project_dir"),
        F.when(is_b & (cust % 2 == 0), cat("https://git/x", c("n_nationkey"))).alias("repo_url"), cat("/w/", cust % 5).alias("cwd"),
        F.when(k % 97 != 0, day_ms + (k * 7919 % 86400) * 1000).alias("started_ms"), day_ms.alias("mtime_ms"),
        F.when(k % 5 > 0, k % 100000).alias("duration_ms"), (k % 9).alias("user_turns"),
        F.concat(cat("Prompt of session ", k), F.repeat(F.lit(" and more"), (k % 20).cast("int"))).alias("first_prompt"),
        cost.alias("total_cost"), (c("o_orderstatus") != "P").alias("cost_is_complete"), (k % 1000000).alias("total_tokens"),
        F.when(c("o_orderstatus") == "O", cost * 0.9).when(c("o_orderstatus") == "F", cost * 0.4).alias("main_cost"),
        F.when(c("o_orderstatus") == "O", cost * 0.1).when(c("o_orderstatus") == "F", cost * 0.6).alias("sub_cost"),
        (k % 700000).alias("main_tokens"), (k % 300000).alias("sub_tokens"), (k % 8).alias("sub_messages"),
        F.floor(k % 8 / 3).cast("bigint").alias("top_tier_messages"), (k % 3).alias("compactions"),
        F.when(ret, 1 + k % 6).alias("returns"), F.when(ret, k % 60000).alias("return_chars"), F.when(ret, k * 13 % 50000).alias("return_max_chars"),
        (k % 13).alias("bash_calls"), (k * 31 % 50000).alias("bash_chars"), F.when(cust % 3 != 0, (k * 17 % 9000) / 1000).alias("bash_usd"),
        (k * 37 % 400000).alias("max_context_tokens"), (k % 8).alias("subagents"),
        F.when(k % 2 == 0, F.array(one, two)).otherwise(F.array(one)).alias("usage_by_model"),
    )


@role(
    "item_models",
    """
    SELECT session, 'brand#' || (k % 5) AS model, k % 1000 AS input_tokens, k % 100 AS output_tokens, k % 5000 AS cache_read_tokens, k % 300 AS cache_write_tokens,
      CASE WHEN k % 10 <> 0 THEN total_cost * 0.75 END AS cost FROM items
    UNION ALL SELECT session, 'opus-4', k % 77, k % 55, 0, 0, total_cost * 0.25 FROM items WHERE k % 2 = 0
    """,
    "items",
)
def item_models(t) -> DataFrame:
    return t.items.select("session", F.explode("usage_by_model").alias("m")).select("session", "m.*")


KEY_SQL = """coalesce(repo_root, CASE WHEN source <> 'codex' THEN 'claude-project:' || coalesce(project_dir, '') END, 'codex-repo:' || repo_url, 'codex-cwd:' || cwd)"""


@role("keyed_items", f"SELECT *, {KEY_SQL} AS repo_key FROM items", "items")
def keyed_items(t) -> DataFrame:
    from ..plans import items as plan

    return plan.with_repo_key(t.items)


@role(
    "ledger",
    """
    SELECT 'L' || c_custkey AS id, '/repos/' || n_name AS repo_key, (828000000 + c_custkey * 86400 % 150000000) * 1000 AS created_ms,
      CASE c_custkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'applied' WHEN 2 THEN 'verified' ELSE 'rejected' END AS status,
      CASE WHEN c_custkey % 50 <> 0 THEN 'Finding ' || c_mktsegment END AS finding, 'Change ' || c_custkey AS change,
      CASE WHEN c_custkey % 4 > 0 THEN (828000000 + c_custkey * 86400 % 150000000 + 86400 * (c_custkey % 9)) * 1000 END AS applied_ms,
      CASE WHEN c_custkey % 4 > 1 THEN (828000000 + c_custkey * 86400 % 150000000 + 86400 * (c_custkey % 30)) * 1000 END AS resolved_ms,
      CASE WHEN c_custkey % 3 = 0 THEN 'costPerDayUsd' ELSE 'other' END AS metric, c_acctbal AS before, c_acctbal / 2 AS after, c_custkey
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
def ledger(t) -> DataFrame:
    c = F.col
    k = c("c_custkey")
    base = F.lit(828000000).cast("bigint") + k * 86400 % 150000000
    status = F.when(k % 4 == 0, F.lit("open")).when(k % 4 == 1, F.lit("applied")).when(k % 4 == 2, F.lit("verified")).otherwise(F.lit("rejected"))
    joined = t.raw("customer").join(t.raw("nation").select("n_nationkey", "n_name"), c("c_nationkey") == c("n_nationkey"))
    return joined.select(
        F.concat(F.lit("L"), k.cast("string")).alias("id"), F.concat(F.lit("/repos/"), c("n_name")).alias("repo_key"), (base * 1000).alias("created_ms"),
        status.alias("status"), F.when(k % 50 != 0, F.concat(F.lit("Finding "), c("c_mktsegment"))).alias("finding"),
        F.concat(F.lit("Change "), k.cast("string")).alias("change"), F.when(k % 4 > 0, (base + 86400 * (k % 9)) * 1000).alias("applied_ms"),
        F.when(k % 4 > 1, (base + 86400 * (k % 30)) * 1000).alias("resolved_ms"),
        F.when(k % 3 == 0, F.lit("costPerDayUsd")).otherwise(F.lit("other")).alias("metric"), c("c_acctbal").alias("before"), (c("c_acctbal") / 2).alias("after"), "c_custkey",
    )
