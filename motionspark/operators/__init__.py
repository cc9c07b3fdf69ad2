"""DataFrame in, DataFrame out, keyed by recording_id."""
