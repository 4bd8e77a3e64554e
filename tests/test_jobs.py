"""Building a query's plan runs no job, but for the bounded read of a catalogue."""

import pytest

from checks import standins
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
NO_JOB = [
    "q_combine_a", "q_combine_b", "q_combine_c", "q_new_corpus_rows", "q_text_dedupe", "q_keyed_merge", "q_insert_if_absent", "q_hypotheses",
    "q_prompts", "q_nli_scores", "q_grid", "q_grid_todo", "q_best_config", "q_macro_mean", "q_votes", "q_vote_eval", "q_vote_todo",
    "q_unprocessed", "q_projects_todo", "q_weighted_sentiment", "q_histogram",
]
#: Queries that read a catalogue, with the jobs of that one read: its shuffles are jobs of their own.
CATALOGUE = {"q_keyword_join": 3, "q_label_corpus": 3, "q_metrics": 3, "q_matches": 3, "q_sim_join_v1": 7, "q_sim_join_v2": 7, "q_crosstab": 7}


@pytest.fixture
def jobs_of(spark, monkeypatch):
    """Jobs that a query runs before it returns; finding a file's columns is not counted."""
    tables = {}

    def table(session, sf_dir, name):
        if name not in tables:
            spark.sparkContext.setJobGroup("tables", "")
            tables[name] = session.read.parquet(f"{sf_dir}/{name}.parquet")
            spark.sparkContext.setJobGroup("plans", "")
        return tables[name]

    monkeypatch.setattr(standins, "table", table)

    def count(name):
        seen = set(spark.sparkContext.statusTracker().getJobIdsForGroup("plans"))
        spark.sparkContext.setJobGroup("plans", "")
        QUERIES[name](spark, SF)
        spark.sparkContext.setJobGroup("after", "")
        return len(set(spark.sparkContext.statusTracker().getJobIdsForGroup("plans")) - seen)

    return count


@pytest.mark.parametrize("name", NO_JOB)
def test_no_job_before_the_result_is_asked_for(jobs_of, name):
    assert jobs_of(name) == 0


@pytest.mark.parametrize("name, most", CATALOGUE.items())
def test_only_the_catalogue_is_read(jobs_of, name, most):
    assert 1 <= jobs_of(name) <= most
