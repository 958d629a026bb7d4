"""Structured Streaming: panes, the keyed result table and the jobs."""
