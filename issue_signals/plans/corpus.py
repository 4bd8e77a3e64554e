"""The corpus table: combined and cleaned issue texts, built in full or above the last transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.combine import combined_issues
from ..operators.progress import above_watermark


def new_corpus_rows(issues: DataFrame, comments: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows to append to the corpus: issues above its highest id. Comments of other issues are
    dropped before they are put together."""
    fresh = above_watermark(issues, corpus)
    wanted = above_watermark(comments, corpus)
    return combined_issues(fresh, wanted)
