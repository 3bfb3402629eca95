"""The order of a trace reads the records of its sessions once."""

import __spark_entry__ as entry

from trailmarts.catalog import q_transcripts


def test_trace_order_makes_the_records_once(spark, monkeypatch):
    """Lines were made, parsed and written a second time for the hidden calls."""
    labels, write = [], q_transcripts.stored
    monkeypatch.setattr(q_transcripts, "stored", lambda df, label="stage": (labels.append(label), write(df, label))[1])
    entry.queries()["trace_order"](spark, "/root/testdata/sf0.001")
    assert labels.count("records") == 1
