"""Transcripts on disk: splits, odd lines, side files, both formats, incremental reads."""

import json
import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trailmarts.operators import forest, records_a, records_b, tools, usage
from trailmarts.plans import items
from trailmarts.sources import marts, telemetry, transcripts
from trailmarts.streaming import jobs


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))


def say(n, **extra):
    return {"type": "assistant", "timestamp": "2026-01-01T00:00:00.000Z", "message": {"id": f"m{n}", "model": "m", "content": [{"type": "text", "text": f"t{n}"}], "usage": {"input_tokens": n}}, **extra}


@pytest.fixture()
def projects(tmp_path):
    root = tmp_path / "projects"
    put(root / "p1" / "s1.jsonl", say(1), "", "{broken", say(2), {"foo": 1},
        {"type": "assistant", "message": {"id": "m3", "content": [{"type": "tool_use", "id": "call1", "name": "Agent", "input": {"description": "look"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "call1", "content": [{"type": "text", "text": "Run ID: r1"}]}]}, "toolUseResult": {"agentId": "x1"}})
    put(root / "p1" / "s1" / "subagents" / "agent-x1.jsonl", say(7))
    put(root / "p1" / "s1" / "subagents" / "agent-x2.jsonl", say(8))
    put(root / "p1" / "s1" / "subagents" / "agent-x2.meta.json", {"agentType": "explorer", "toolUseId": "call9"})
    put(root / "p1" / "s1" / "subagents" / "workflows" / "r1" / "agent-x3.jsonl", say(9))
    put(root / "p1" / "s1" / "subagents" / "workflows" / "r1" / "journal.jsonl", {"type": "x"})
    put(root / "p1" / "s1" / "workflows" / "r1.json", {"runId": "r1", "workflowName": "w", "status": "completed", "phases": [{"title": "plan"}, {"detail": "no title"}],
                                                     "workflowProgress": [{"type": "workflow_agent", "agentId": "x3", "state": "done", "phaseTitle": "plan"}, {"type": "other"}]})
    put(root / "p1" / "s1" / "workflows" / "bad.json", "{")
    put(root / "p1" / "s1" / "workflows" / "noid.json", {"status": "x"})
    return root


def test_line_numbers_survive_splits(spark, tmp_path):
    lines = [json.dumps(say(i, pad="x" * (i % 50))) if i % 7 else "" for i in range(1, 2001)]
    put(tmp_path / "p" / "big.jsonl", *lines)
    put(tmp_path / "p" / "small.jsonl", *lines[:3])
    limit = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "20000")
    try:
        for whole in (transcripts.WHOLE_BYTES, 1000):
            read = transcripts.raw_lines(spark, str(tmp_path), whole_bytes=whole)
            got = read.where(F.col("path").endswith("big.jsonl")).orderBy("line").collect()
            assert [(r.line, r.text) for r in got] == list(enumerate(lines, 1))
            assert read.where(F.col("path").endswith("small.jsonl")).count() == 3
        splits = spark.read.text(str(tmp_path / "p" / "big.jsonl")).select("_metadata.file_block_start").distinct().count()
        assert splits > 5
    finally:
        spark.conf.set(limit, old)


def test_line_breaks_and_blank_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"one\r\n\r\nthree\rfour")
    (tmp_path / "b.jsonl").write_bytes(b"")
    (tmp_path / "c.jsonl").write_bytes(b"\n")
    for whole in (transcripts.WHOLE_BYTES, 0):
        got = transcripts.raw_lines(spark, str(tmp_path), whole_bytes=whole)
        assert rows(got.where(F.col("path").endswith("a.jsonl")), "line", "text") == [(1, "one"), (2, ""), (3, "three"), (4, "four")]
        assert rows(got.where(~F.col("path").endswith("a.jsonl")), "line", "text") == [(1, "")]


def test_files_of_ordinary_size_are_numbered_without_a_shuffle(spark, projects):
    off = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(off)
    spark.conf.set(off, "-1")
    try:
        plan = transcripts.format_a(spark, str(projects))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(off, old)
    read = transcripts.format_a(spark, str(projects)).where("thread = 'main'")
    assert [r.line for r in read.orderBy("line").collect()] == [1, 2, 3, 4, 5, 6, 7]
    assert plan.count("FileScan text") <= 3  # whole files; large files for their lines and for the lines of each split
    assert plan.count("Exchange") <= 4 and "hashpartitioning(path" in plan.replace("#", "")[:len(plan)] or "Exchange" not in plan


def test_format_a_files(spark, projects):
    lines = transcripts.format_a(spark, str(projects))
    assert rows(lines.select("session", "thread", "project_dir", "run_id").distinct()) == [
        ("s1", "main", "p1", None), ("s1", "x1", "p1", None), ("s1", "x2", "p1", None), ("s1", "x3", "p1", "r1")]
    main = lines.where("thread = 'main'")
    assert rows(records_a.warnings(main), "line", "reason") == [(3, "malformed JSON"), (5, "missing record type")]
    rec = records_a.records(lines)
    assert rows(records_a.snapshots(rec), "thread", "line", "input_tokens") == [
        ("main", 1, 1), ("main", 4, 2), ("main", 6, None), ("x1", 1, 7), ("x2", 1, 8), ("x3", 1, 9)]
    calls = tools.link_results(records_a.tool_calls(rec), records_a.tool_results(rec))
    seen = transcripts.threads(lines.where("thread <> 'main'"), transcripts.thread_meta(spark, str(projects)))
    linked = forest.link_threads(seen, calls, records_a.result_agents(rec))
    assert rows(linked, "agent", "tool_use_id", "spawned_by", "run_id", "agent_type") == [
        ("x1", "call1", "main", None, None), ("x2", "call9", "main", None, "explorer"), ("x3", None, "main", "r1", None)]
    runs = transcripts.workflow_runs(spark, str(projects))
    assert rows(runs, "run_id", "name", "status") == [("r1", "w", "completed")]
    assert rows(transcripts.workflow_phases(spark, str(projects)), "title") == [("plan",)]
    assert rows(transcripts.workflow_agents(spark, str(projects)), "agent", "state", "phase") == [("x3", "done", "plan")]


def rollout(day, uid, *lines):
    return f"{day.replace('-', '/')}/rollout-{day}T10-00-00-{uid}.jsonl", lines


def test_format_b_files(spark, tmp_path):
    uid = ["%08d-1111-1111-1111-111111111111" % i for i in range(3)]
    meta = lambda i: {"timestamp": "2026-07-01T10:00:00Z", "type": "session_meta", "payload": {"id": uid[i], "cwd": "/w"}}
    for i, lines in ((0, [meta(0), "nope"]), (1, [{"type": "turn_context", "payload": {}}])):
        path, body = rollout("2026-07-01", uid[i], *lines)
        put(tmp_path / "sessions" / path, *body)
    put(tmp_path / "archived_sessions" / f"rollout-2026-07-01T10-00-00-{uid[0]}.jsonl", meta(0), meta(0), meta(0))
    lines = transcripts.format_b(spark, str(tmp_path))
    assert lines.where("archived").count() == 3
    best = transcripts.preferred_files(lines)
    assert rows(best.groupBy("session").count()) == [(uid[0], 2), (uid[1], 1)]
    assert rows(records_b.current_files(best).select("session").distinct()) == [(uid[0],)]
    assert rows(records_b.warnings(best), "line", "reason") == [(2, "malformed JSON")]
    assert rows(transcripts.merged(best.where("session LIKE '%0-1111%'"), lines), "session").count((uid[0],)) == 2


def test_titles_and_captures(spark, tmp_path):
    put(tmp_path / "session_index.jsonl", {"id": "a", "thread_name": "one"}, {"id": "a", "thread_name": "two"}, "x")
    put(tmp_path / "d" / "local_1.json", {"cliSessionId": "b", "title": "desk", "createdAt": 5})
    base = spark.createDataFrame([("a", "own"), ("b", None), ("c", "c")], "session string, title string")
    named = items.with_titles(base, transcripts.title_index(spark, str(tmp_path / "session_index.jsonl")), transcripts.desktop_titles(spark, str(tmp_path)))
    assert rows(named, "session", "title") == [("a", "two"), ("b", "desk"), ("c", "c")]
    put(tmp_path / "cap" / "c.jsonl", {"sessionId": "a", "requestId": "r", "status": 200, "latencyMs": 12, "startedAt": "2026-01-01T00:00:00Z"}, '{"sessionId": "a", "req')
    assert rows(telemetry.captures(spark, str(tmp_path / "cap")), "session", "request_id", "status", "latency_ms") == [("a", "r", 200, 12)]
    put(tmp_path / "otel" / "o.jsonl", {"resourceLogs": [{"resource": {"attributes": [{"key": "session.id", "value": {"stringValue": "../x"}}]}}]}, {"resourceMetrics": []})
    routed = telemetry.otlp_lines(spark, str(tmp_path / "otel"))
    assert rows(routed, "session") == [("_unassigned",), ("_unassigned",)]
    for batch in (0, 1, 1):
        telemetry.write_by_session(routed, str(tmp_path / "out"), batch)
    assert rows(telemetry.exported(spark, str(tmp_path / "out")), "batch", "session") == [(b, "_unassigned") for b in (0, 0, 1, 1)]
    assert len([p for p in (tmp_path / "out" / "batch=1" / "session=_unassigned").iterdir() if p.suffix == ".txt"]) == 1


def test_items_are_written_by_day(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 86_400_000, 1), ("b", "x", None, 5)], "session string, source string, started_ms bigint, mtime_ms bigint")
    marts.write_items(df, str(tmp_path / "m"))
    days = tmp_path / "m" / "source=x"
    assert sorted(p.name for p in days.iterdir() if p.name.startswith("day")) == ["day=1970-01-01", "day=1970-01-02"]
    untouched = sorted((p.name, p.stat().st_mtime_ns) for p in (days / "day=1970-01-01").iterdir())
    changed = spark.createDataFrame([("a", "x", 86_400_000, 9), ("c", "x", 86_400_001, 2)], df.schema)
    marts.refresh_items(changed, str(tmp_path / "m"))
    assert sorted((p.name, p.stat().st_mtime_ns) for p in (days / "day=1970-01-01").iterdir()) == untouched
    assert rows(marts.read_items(spark, str(tmp_path / "m")), "session", "mtime_ms") == [("a", 9), ("b", 5), ("c", 2)]


def test_ingest_follows_files(spark, tmp_path):
    """New, grown, rewritten, cut, half-written and unchanged files over several runs, each a restart from the checkpoint."""
    root, table = tmp_path / "in", str(tmp_path / "table")
    long = [f"line {i} " + "é" * (i % 9) for i in range(400)]

    def run():
        jobs.ingest_lines(spark, str(root), table, piece=1000)
        found = jobs.current_lines(spark, table)
        got = {}
        for r in found.orderBy("path", "line").collect():
            got.setdefault(os.path.basename(r.path), []).append((r.line, r.text))
        assert all([n for n, _ in lines] == list(range(1, len(lines) + 1)) for lines in got.values())
        return {k: [x for _, x in v] for k, v in got.items()}

    def batches():
        return sorted(int(p.name.split("=")[1]) for p in (tmp_path / "table" / "out").iterdir() if p.name.startswith("batch="))

    put(root / "a.jsonl", "1", "2")
    put(root / "d" / "long.jsonl", *long)
    (root / "half.jsonl").write_text("whole\nhal")
    (root / "other.txt").write_text("no\n")
    assert run() == {"a.jsonl": ["1", "2"], "long.jsonl": long, "half.jsonl": ["whole"]}
    put(root / "b.jsonl", "x", "", "y")
    with open(root / "d" / "long.jsonl", "a") as f:
        f.write("more\r\nlines\n")
    with open(root / "half.jsonl", "a") as f:
        f.write("f\nnext\n")
    second = run()
    assert second == {"a.jsonl": ["1", "2"], "b.jsonl": ["x", "", "y"], "long.jsonl": [*long, "more", "lines"], "half.jsonl": ["whole", "half", "next"]}
    last = max(batches())
    added = spark.read.parquet(f"{table}/out/batch={last}")
    assert added.where(F.col("path").endswith("long.jsonl")).count() == 2 and not added.where(F.col("path").endswith("a.jsonl")).count()
    put(root / "a.jsonl", "other", "text", "and more than before")  # longer, but not the same beginning
    put(root / "b.jsonl", "x")  # shorter
    assert run() == second | {"a.jsonl": ["other", "text", "and more than before"], "b.jsonl": ["x"]}
    seen = batches()
    assert run() == second | {"a.jsonl": ["other", "text", "and more than before"], "b.jsonl": ["x"]}
    assert [b for b in batches() if b not in seen] == [] or not spark.read.parquet(f"{table}/out/batch={max(batches())}").count()


def test_pieces_of_any_size_give_the_same_lines(tmp_path):
    from trailmarts.streaming import growing

    text = "".join(f"{'x' * (i * 7 % 40)}{i}" + ("\r\n" if i % 3 else "\n") for i in range(60))
    (tmp_path / "f.jsonl").write_bytes(text.encode() + b"tail without end")
    want = text.replace("\r\n", "\n").split("\n")[:-1]
    for piece in (1, 7, 64, 1000, 1 << 20):
        reader = growing.GrowingReader({"path": str(tmp_path), "piece": str(piece)})
        got = [x for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for batch in reader.read(p) for x in batch.column("text").to_pylist()]
        assert got == want


def test_side_files_of_several_lines(spark, tmp_path):
    body = json.dumps({"runId": "r1", "status": "completed", "phases": [{"title": "one"}]}, indent=2)
    path = tmp_path / "p" / "s1" / "workflows" / "x.json"
    path.parent.mkdir(parents=True)
    path.write_text(body)
    assert "\n" in body and rows(transcripts.workflow_runs(spark, str(tmp_path)), "session", "run_id", "status") == [("s1", "r1", "completed")]


def test_large_files_are_numbered_without_a_shuffle_of_text(spark, tmp_path):
    put(tmp_path / "p" / "big.jsonl", *[f"line {i}" for i in range(500)])
    read = transcripts.raw_lines(spark, str(tmp_path), whole_bytes=100)
    off = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(off)
    spark.conf.set(off, "-1")
    try:
        plan = read._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(off, old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [(r.line, r.text) for r in read.orderBy("line").collect()] == [(i + 1, f"line {i}") for i in range(500)]
    assert transcripts.splits_at_most(spark, str(tmp_path), "*.jsonl", 100) >= 1 and transcripts.splits_at_most(spark, str(tmp_path), "*.jsonl", 1 << 30) == 0


def counts_stream(spark, folder, batches):
    """A stream of format B counts, one batch to a file; a count is (session, line, ts_ms, total)."""
    names = records_b.COUNTERS
    schema = "session string, line bigint, ts_ms bigint, has_info boolean, " + ", ".join(f"total_{c} bigint, last_{c} bigint" for c in names)
    for batch in batches:
        data = [(s, line, ts, True, *(x for _ in names for x in (total, line))) for s, line, ts, total in batch]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_counts_in_any_order_move_alike_and_state_ends(spark, tmp_path):
    rng, minute, want, arriving = random.Random(4), 60_000, [], []
    for s in "abc":
        total = None
        for line in range(1, 61):
            new = total if total is not None and rng.random() < 0.4 else rng.randrange(5)
            if new != total:
                want.append((s, line))
            total = new
            # Every tenth count has no time; none comes more than 15 minutes after a newer one.
            arriving.append((line + rng.randrange(15), (s, line, None if line % 10 == 3 else line * minute, total)))
    arriving.sort(key=lambda x: x[0])
    rows_ = [r for _, r in arriving]
    batches = [rows_[i : i + 45] for i in range(0, len(rows_), 45)]
    batches[1] += batches[0][:5]  # sent twice
    batches.append([("end", 1, 60 * 24 * 60 * minute, 1)])
    stream = counts_stream(spark, str(tmp_path / "in"), batches)
    kept = jobs.run_available(jobs.counter_deltas(stream, "20 minutes"), str(tmp_path / "job"), rocksdb=True)
    assert rows(jobs.output(spark, str(tmp_path / "job")), "session", "line") == sorted(want, key=repr)
    assert max(kept) >= 3 and kept[-1] == 1, kept  # a list counts as one; only that of the last session is left


def test_messages_drop_the_state_of_passed_days(spark, tmp_path):
    day, schema = 86_400_000, "session string, thread string, message_id string, line bigint, model string, ts_ms bigint, has_usage boolean, " + ", ".join(f"{c} bigint" for c in usage.USAGE)
    for i in range(4):
        data = [("s", "main", f"m{i}-{j}", i * 100 + j, "m", i * 10 * day + j, True, *(j for _ in usage.USAGE)) for j in range(20)]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = jobs.run_available(jobs.message_updates(stream, "5 days"), str(tmp_path / "job"), "update")
    assert max(kept) <= 40 and kept[-1] == 20
    assert jobs.merged_messages(jobs.output(spark, str(tmp_path / "job"))).count() == 80


def test_many_small_files_take_few_tasks(spark, tmp_path):
    """Files are written, numbered, ingested and exported by tasks that hold many of them."""
    from trailmarts.sources.files import TASKS_A_CORE, write_files
    from trailmarts.streaming import growing

    most = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    lines = spark.range(3000).selectExpr("concat('p', id % 7, '/f', id % 1500, '.jsonl') AS name", "id AS line", "concat('x', id) AS text", "'\n' AS ending")
    assert write_files(lines, str(tmp_path / "in")) == len(list((tmp_path / "in").rglob("*.jsonl"))) == lines.select("name").distinct().count()
    read = transcripts.raw_lines(spark, str(tmp_path / "in"))
    assert read.rdd.getNumPartitions() <= 2 * most and rows(read, "text") == sorted((f"x{i}",) for i in range(3000))
    reader = growing.GrowingReader({"path": str(tmp_path / "in")})
    shares = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(shares) < 20 and sum(b.num_rows for s in shares for b in reader.read(s)) == 3000


def test_exports_keep_odd_session_names_and_split_large_sessions(spark, tmp_path):
    names = ["a:b+c d%41é", "x=y?z", "[q]{r}^'\"#*\\", "plain", "large"]
    routed = spark.createDataFrame([(n, f"t{i}") for i in range(3) for n in names] + [("large", f"t{i}") for i in range(3, 400)], "session string, text string")
    for batch in (0, 1, 1):
        telemetry.write_by_session(routed, str(tmp_path / "out"), batch, lines_per_file=100)
    want = sorted(((b, *r) for b in (0, 1) for r in rows(routed)), key=repr)
    assert rows(telemetry.exported(spark, str(tmp_path / "out")), "batch", "session", "text") == want
    assert rows(spark.read.text(str(tmp_path / "out")), "batch", "session", "value") == want
    files = list((tmp_path / "out" / "batch=1" / "session=large").iterdir())
    assert len(files) > 3 and len(list((tmp_path / "out" / "batch=1" / "session=plain").iterdir())) == 1
