"""Child process for the kill test: runs the running-totals stream forever."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from changefold import operators as ops  # noqa: E402
from changefold.session import build_session  # noqa: E402
from changefold.sources import read_envelope_stream  # noqa: E402
from changefold.streaming import jobs  # noqa: E402


def main(landing: str, table: str, ckpt: str) -> None:
    spark = build_session(master="local[2]", shuffle_partitions=4)
    jobs.configure_streaming(spark)
    stream = read_envelope_stream(spark, landing, options={"maxFilesPerTrigger": "1"})
    totals = jobs.bot_ratio_stream(ops.article_edits(ops.parse_edits(stream)))
    jobs.start_changelog(totals, table, ckpt, {"processingTime": "200 milliseconds"}).awaitTermination()


if __name__ == "__main__":
    main(*sys.argv[1:4])
