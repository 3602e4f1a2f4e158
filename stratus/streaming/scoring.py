"""Score processed observation files as they arrive.

The reference scores whole files on request; here the same per-row scoring
(``plans.scoring.score_batch``) runs over a file stream so new files are scored once
each.  No state is kept between micro-batches; progress lives in the checkpoint
location (under ``spark.checkpoint.dir`` unless given), so a restarted or
executor-lost query resumes without rescoring or skipping files.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stratus.plans.scoring import score_batch
from stratus.session import checkpoint_dir
from stratus.sources.models import ModelBundle


def score_files_stream(
    spark: SparkSession,
    bundle: ModelBundle,
    source_dir: str,
    schema: T.StructType,
    sink_dir: str,
    checkpoint_location: str | None = None,
    fmt: str = "parquet",
    available_now: bool = True,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Start a query that scores every new file in ``source_dir`` into ``sink_dir``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).format(fmt).load(source_dir)
    scored = score_batch(bundle, stream)
    # named after the whole path: two sinks of one name keep their progress apart
    name = hashlib.sha256(sink_dir.rstrip("/").encode()).hexdigest()[:24]
    location = checkpoint_location or os.path.join(checkpoint_dir(spark), "stratus-score-stream", name)
    writer = scored.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", location).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
