"""Readers and writers: transcripts, telemetry, captures, prices, marts."""
