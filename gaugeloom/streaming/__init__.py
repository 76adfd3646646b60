"""Streams: rates over event time, stateful livelock and patrol reports, gates on micro-batches."""
