"""Null rules, running values, skewed joins, shell parsing, prices."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trailmarts.functions import nulls, shell, text
from trailmarts.functions.ordered import numbered, running
from trailmarts.functions.skew import salted_join
from trailmarts.operators import pricing


def test_sums_and_unknowns(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", 2.0)], "k string, x double")
    out = df.groupBy("k").agg(nulls.known_sum(F.col("x")).alias("known"), nulls.strict_sum(F.col("x")).alias("strict"))
    assert rows(out, "k", "known", "strict") == [("a", 1.0, None), ("b", None, None), ("c", 2.0, 2.0)]
    empty = df.where("false").agg(nulls.strict_sum(F.col("x")).alias("s")).first()
    assert empty.s == 0.0


def test_ratios_and_spans(spark):
    df = spark.createDataFrame([(1.0, 0.0, 5, 3), (1.0, 2.0, 3, 5), (None, 2.0, None, 5)], "a double, b double, s int, e int")
    out = df.select(
        nulls.ratio_or_null(F.col("a"), F.col("b")), nulls.ratio_or_zero(F.col("a"), F.col("b")), nulls.pct_change(F.col("a"), F.col("b")), nulls.span_ms(F.col("s"), F.col("e")))
    assert [tuple(r) for r in out.collect()] == [(None, 0.0, None, None), (0.5, 0.5, -50.0, 2), (None, None, None, None)]


@pytest.mark.parametrize("chunk_rows", [1, 3, 1000])
def test_running_values_match_a_plain_scan(spark, chunk_rows):
    rng = random.Random(7)
    data = []
    for key in ("hot", "b", "c"):
        lines = sorted(rng.sample(range(200), 80 if key == "hot" else 5))
        data += [(key, n, rng.randint(-5, 9), rng.choice([None, 1, 2])) for n in lines]
    df = spark.createDataFrame(data, "k string, line bigint, x bigint, y bigint")
    out = running(df, ["k"], "line", {
        "s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("y")), "p": ("prev", F.col("y"))}, chunk_rows=chunk_rows)
    want = []
    for key in ("hot", "b", "c"):
        total, top, last, prev = 0, None, None, None
        for k, n, x, y in sorted(r for r in data if r[0] == key):
            total, top, last = total + x, x if top is None else max(top, x), y if y is not None else last
            want.append((k, n, total, top, last, prev))
            prev = y
    assert rows(out, "k", "line", "s", "m", "l", "p") == sorted(want, key=repr)
    count = numbered(df, ["k"], "line", chunk_rows=chunk_rows).groupBy("k").agg(F.max("seq")).collect()
    assert {r[0]: r[1] for r in count} == {"hot": 80, "b": 5, "c": 5}


def test_salted_join_keeps_every_row(spark):
    many = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id") % 7).alias("k"), "id")
    one = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        plain = rows(many.join(one, "k", how), "id", "v")
        assert rows(salted_join(many, one, ["k"], how, salts=8, share=0.1, floor=10), "id", "v") == plain


COMMANDS = [
    ("git -C x status", "git", "x"),
    ("cd a && git log", "git", "log"),
    ("FOO=1 BAR='a b' env BAZ=2 npm run build", "npm", "run"),
    ("time nice -n 5 make all", "make", None),
    ("xargs -I {} rm {}", "rm", None),
    ("echo hi", "echo", None),
    ("cd /foo", None, None),
    ("echo \"a | b; c\" | jq .x", "jq", None),
    ("for f in *; do cat $f; done", None, None),
    ("cat <<EOF > out", "cat", None),
    ("", None, None),
    ("docker run --rm 'my image' > log 2>&1", "docker", "run"),
    ("gh pr view \"$(git branch | head)\"", "gh", "pr"),
]


def test_shell_programs(spark):
    df = spark.createDataFrame([(c,) for c, _, _ in COMMANDS], "c string")
    got = df.select("c", shell.primary(shell.segments(F.col("c"))).alias("p")).select("c", "p.program", "p.subcommand").collect()
    assert [tuple(r) for r in got] == COMMANDS


def test_file_reads_through_the_shell(spark):
    cases = {
        "cat a.txt": True, "cat a.txt > b": False, "head -n 100": False, "head -n 100 f": True, "sed -n '1,20p' f": True, "sed -n '1,20p'": False,
        "sed s/a/b/ f": False, "tail -f x 2>/dev/null": True, "cat": False, "less >out f": False,
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r[0]: r[1] for r in df.select("c", F.get(shell.segments(F.col("c")), F.lit(0))["reads_file"]).collect()}
    assert got == cases


def test_shapes(spark):
    cases = {
        'git commit -m "fix 1"': "git commit -m <STR>", "ls /a/b 12  x": "ls <PATH> <NUM> x", "a1 2.5 b/c": "a1 <NUM> <PATH>", "'x y'": "<STR>",
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r[0]: r[1] for r in df.select("c", shell.shape(F.col("c"))).collect()} == cases


def test_error_classes_take_the_first_match(spark):
    df = spark.createDataFrame([("ENOENT and exit code 1",), ("Timed out",), ("fatal: x",), ("hm",)], "t string")
    assert [r[0] for r in df.select(text.error_class(F.col("t"))).collect()] == ["file-not-found", "timeout", "command-failed", "other"]


PRICE = "model string, valid_from date, input_rate double, output_rate double, cache_write_rate double, cache_read_rate double, input_rate_200k double, " \
    "output_rate_200k double, cache_write_rate_200k double, cache_read_rate_200k double, cache_write_1h_rate double"


def prices(spark, *entries):
    wide = [(m, d, i, o, *([None] * 7)) for m, d, i, o in entries]
    return spark.createDataFrame(wide, "model string, valid_from string, " + PRICE.split(", ", 2)[2]).withColumn("valid_from", F.col("valid_from").cast("date")).select(
        "model", "valid_from", *pricing.RATES)


def test_price_lookup(spark):
    table = prices(spark, ("m-x", None, 1.0, 2.0), ("m-x", "2024-06-01", 3.0, 4.0), ("m-x-mini", "2024-06-01", 5.0, 6.0), ("m", None, 9.0, 9.0))
    day = 86_400_000
    before, after = 19_800 * day, 19_900 * day  # 2024-03-18 and 2024-06-26
    use = spark.createDataFrame(
        [("m-x", before, 1), ("m-x", after, 1), ("m-x-20240101", before, 1), ("m-x-mini-2", before, 1), ("m-x-mini-2", after, 1), ("us.anthropic.m-x-v1:0", after, 1), ("zz", after, 1), ("zz", after, 0), ("m-x", None, 1)],
        "model string, ts_ms bigint, input_tokens bigint").selectExpr("*", "0L output_tokens", "0L cache_read_tokens", "0L cache_write_tokens", "monotonically_increasing_id() AS i")
    got = [r[0] for r in pricing.priced(use, table).orderBy("model", "ts_ms", "input_tokens").select("cost").collect()]
    # m-x: undated, before, after; dated id; mini has no entry yet and must not fall back to m-x; hosted id; unknown model.
    assert got == [3.0, 1.0, 3.0, 1.0, None, 5.0, 3.0, 0.0, None]


def test_tiers_and_write_rates(spark):
    table = spark.createDataFrame([("m", None, 1.0, 2.0, None, None, 10.0, 20.0, None, 0.5, None)], "model string, valid_from string, " + PRICE.split(", ", 2)[2]).withColumn(
        "valid_from", F.col("valid_from").cast("date"))
    use = spark.createDataFrame(
        [("m", 0, 100, 10, 50, 40, None, None), ("m", 0, 200_000, 1, 1, 0, None, None), ("m", 0, 1, 0, 0, 9, 4, 5)],
        "model string, ts_ms bigint, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, cache_write_5m_tokens bigint, cache_write_1h_tokens bigint")
    got = rows(pricing.priced(use, table), "input_cost", "output_cost", "cache_read_cost", "cache_write_cost")
    assert got == sorted([(100.0, 20.0, 5.0, 50.0), (2_000_000.0, 20.0, 0.5, 0.0), (1.0, 0.0, 0.0, 15.0)], key=repr)


def test_price_history_rejects_two_changes_on_a_day(spark):
    table = prices(spark, ("m", "2024-06-01", 1.0, 2.0))
    fresh = prices(spark, ("m", None, 5.0, 6.0)).drop("valid_from")
    day = F.lit("2024-06-01").cast("date")
    merged, added = pricing.merge_history(table, prices(spark, ("m", None, 1.0, 2.0)).drop("valid_from"), day)
    assert merged.count() == 1 and added.count() == 0
    assert rows(pricing.merge_history(table, fresh, F.lit("2024-07-01").cast("date"))[0], "input_rate") == [(1.0,), (5.0,)]
    with pytest.raises(Exception, match="changed twice"):
        pricing.merge_history(table, fresh, day)[0].collect()


def test_last_value_of_earlier_rows(spark):
    data = [(k, i, (i * 7 + len(k)) % 5 or None) for k in ("a", "bb") for i in range(60)]
    df = spark.createDataFrame(data, "k string, i bigint, v bigint")
    got = {(r.k, r.i): r.p for r in running(df, ["k"], "i", {"p": ("past", F.col("v"))}, chunk_rows=8).collect()}
    for key in ("a", "bb"):
        held = None
        for k, i, v in (d for d in data if d[0] == key):
            assert got[k, i] == held
            held = v if v is not None else held
