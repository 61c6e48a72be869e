"""Streams: state by key in event time, with a stated policy for late rows."""
