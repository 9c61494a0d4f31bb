"""Bank feed into the synced table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallymill.operators.normalize import normalize
from tallymill.sources.transactions import read_synced, write_synced


def sync(feed: DataFrame, path: str) -> DataFrame:
    """Normalise a feed, replace the synced table with it and return that table."""
    write_synced(normalize(feed), path)
    return read_synced(feed.sparkSession, path)
