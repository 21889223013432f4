"""Keeping a published dataset up to date with a replication feed.

Batches may hold several sequences; they are applied in the order of (seq, pos) at once.  The sequence number is published
together with the tables, so a batch that comes again after a failure is recognised and skipped.  Each batch is a delta, so
what it writes follows the size of its changes; versions that are no longer needed are deleted after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrafold.dataset import SEQNUM, TIMESTAMP, OsmDataset, vacuum, writer_lock
from terrafold.operators.update import apply_file
from terrafold.scratch import Scratch
from terrafold.sources.replication import Feed, timestamp_text
from terrafold.sources.xmlfiles import epoch, register


#: Versions that stay readable, for readers that opened one.
KEEP_VERSIONS = 10


def start_sequence(db: OsmDataset, feed: Feed) -> int:
    """The dataset's sequence number, or the one that its timestamp falls to."""
    if number := db.get_metadata(SEQNUM):
        return int(number)
    when = epoch(db.get_metadata(TIMESTAMP))
    if when is None:
        raise ValueError("the dataset has neither a sequence number nor a timestamp")
    return feed.sequence_at(when)


def apply_batch(spark: SparkSession, root: str, feed: Feed, batch: DataFrame) -> int | None:
    """Publish the next version; None if the batch has nothing new."""
    db = OsmDataset.open(spark, root)
    done = int(db.get_metadata(SEQNUM) or -1)
    fresh, m = Scratch(spark).save(batch.where(F.col("seq") > done), last=F.max("seq"))  # fetched and parsed once
    if not m["n"]:
        return None
    last = m["last"]
    return apply_file(db, fresh, root, last, timestamp_text(feed.state(last).timestamp), commit=True)


def catch_up(spark: SparkSession, base: str, root: str, checkpoint: str, suffix: str = "osc.gz", keep: int = KEEP_VERSIONS) -> StreamingQuery:
    """Apply all sequences after the dataset's own, up to the latest now.

    A long absence is one batch, in which each sequence is a task of its own; it is applied at once, as the last change of
    an element makes all earlier ones superfluous.
    """
    register(spark)
    feed = Feed(base, suffix)
    first = start_sequence(OsmDataset.open(spark, root), feed)
    stream = spark.readStream.format("change_feed").option("startingSequence", first).option("suffix", suffix).load(base)

    def run(batch: DataFrame, _: int) -> None:
        with writer_lock(root, batch.sparkSession):
            if apply_batch(batch.sparkSession, root, feed, batch) is not None:
                vacuum(batch.sparkSession, root, keep)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()
