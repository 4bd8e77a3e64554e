"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once over the smallest tables first, so that the numbers are those of a warm
session. The result is computed in full and written nowhere.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from issue_signals.session import local_session  # noqa: E402

HEADLINES = [
    "q_land_issues", "q_insert_if_absent", "q_keyed_merge", "q_combine_a", "q_combine_c", "q_text_dedupe", "q_valid_text",
    "q_content_type", "q_context", "q_reason", "q_clean_issue", "q_chunk_pack", "q_chunk_fixed", "q_chunk_lines",
    "q_unprocessed", "q_mean_vector", "q_embed", "q_sim_join_v1", "q_sim_join_v2", "q_word_lookup", "q_keyword_join",
    "q_hypotheses", "q_nli_scores", "q_label_corpus", "q_votes", "q_vote_eval", "q_metrics", "q_grid", "q_grid_todo", "q_sentiment",
    "q_weighted_sentiment", "q_mentions", "q_matches", "q_cap_matches", "q_criteria_report", "q_neighbours", "q_synonyms",
    "q_criteria_daily",
]


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    names = sys.argv[1:] or HEADLINES
    if os.path.isdir(warm):
        for name in names:
            seconds(spark, name, warm)
    taken = {name: round(seconds(spark, name, sf_dir), 3) for name in names}
    result = {
        "metric": "total_seconds", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
