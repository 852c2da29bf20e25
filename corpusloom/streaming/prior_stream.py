"""The prior from a stream of lines: every micro-batch is merged into the store."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.statistics import meta_int
from corpusloom.functions.tokenizers import Tokenizer, words
from corpusloom.plans.prior import PatternConfig, prior_of
from corpusloom.sources import readers, sinks

log = logging.getLogger(__name__)


def maintain_prior(lines: DataFrame, anchors: Iterable[str], store: str, checkpoint: str, config: PatternConfig = PatternConfig(), tokenizer: Tokenizer = words, cap: int = 9999) -> StreamingQuery:
    """Add the available lines (``value``) to the prior below ``store`` and stop.

    Counts are additive, so a batch is aggregated alone and added, to the buckets that it touches.  Both tables change at once, and
    the store remembers the last batch, so one that comes again after a failure at any point is merged once.  A key
    keeps at most ``cap`` realizations over all batches.  Every batch logs what it read and how fast, and adds it to the meta table.
    """
    listed = sorted(set(anchors))
    spark = lines.sparkSession
    sinks.create_prior(spark, store)

    def merge(batch: DataFrame, number: int) -> None:
        began = time.time()
        found = prior_of(batch, listed, config, tokenizer, cap)
        sinks.merge_prior(found.stats, found.realizations, store, cap, f"batch-{number}")
        known = readers.meta(spark, f"{store.rstrip('/')}/meta")
        if known.get("last_batch") != str(number):
            seen, kept = (meta_int(known, key, 0) + n for key, n in (("lines_seen", found.seen), ("sentences_processed", found.kept)))
            sinks.put_meta(spark, store, {"last_batch": number, "lines_seen": seen, "sentences_processed": kept})
            took = time.time() - began
            log.info("batch %s: %s lines, %s sentences, %.0f lines/s; %s lines in all", number, f"{found.seen:,}", f"{found.kept:,}", found.seen / max(took, 1e-3), f"{seen:,}")

    return lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
