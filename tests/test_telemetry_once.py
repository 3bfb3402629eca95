"""The session of an export line is looked for once."""

from conftest import rows

from trailmarts.operators import telemetry

RECORD = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"attributes":[%s]}]}]}]}'


def test_the_session_of_a_line_is_looked_for_once(spark):
    """Each test of the id looked through all attributes of the line again."""
    attrs = ['{"key":7,"value":{"stringValue":"x"}},{"key":["session.id"],"value":{"stringValue":"y"}},{"key":"session.id","value":{"intValue":"12"}}', '{"key":"session.id","value":{"stringValue":" a "}}', '{"key":"session.id","value":{"stringValue":"a/b"}}', '{"value":{}}']
    lines = spark.createDataFrame([(i, RECORD % a) for i, a in enumerate(attrs)], "line bigint, text string")
    found = telemetry.routed(lines).select("line", "session")
    assert rows(found) == [(0, "12"), (1, "a"), (2, "_unassigned"), (3, "_unassigned")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("session.id") == 16  # four places of an id, four kinds of value
