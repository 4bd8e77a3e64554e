"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

L, I, S, B, D, TS = (
    T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.DoubleType(), T.TimestampType(),
)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


PROJECTS = _schema(("id", L), ("repository_url", S))

ISSUES = _schema(
    ("issue_id", L), ("url", S), ("project_id", L), ("repository_id", L), ("repository_url", S),
    ("node_id", S), ("number", I), ("title", S), ("owner", S), ("owner_type", S), ("owner_id", L),
    ("labels", S), ("state", S), ("locked", B), ("comments", I), ("created_at", TS),
    ("updated_at", TS), ("closed_at", TS), ("author_association", S), ("active_lock_reason", S),
    ("body", S), ("body_text", S), ("reactions", S), ("state_reason", S),
)

COMMENTS = _schema(
    ("id", L), ("node_id", S), ("url", S), ("issue_id", L), ("issue_url", S), ("owner", S),
    ("created_at", TS), ("updated_at", TS), ("author_association", S), ("body", S), ("body_text", S),
)

USER = _schema(("login", S), ("type", S), ("id", L))

# Landed JSON. labels and reactions are declared as strings: the reader then keeps their JSON text.
RAW_ISSUES = _schema(
    ("id", L), ("url", S), ("project_id", L), ("repository_id", L), ("repository_url", S),
    ("node_id", S), ("number", I), ("title", S), ("user", USER), ("labels", S), ("state", S),
    ("locked", B), ("comments", I), ("created_at", S), ("updated_at", S), ("closed_at", S),
    ("author_association", S), ("active_lock_reason", S), ("body", S), ("body_text", S),
    ("reactions", S), ("state_reason", S),
)

RAW_COMMENTS = _schema(
    ("id", L), ("node_id", S), ("url", S), ("issue_id", L), ("issue_url", S), ("user", USER),
    ("created_at", S), ("updated_at", S), ("author_association", S), ("body", S), ("body_text", S),
)

COMBINED_ISSUES = _schema(
    ("issue_id", L), ("project_id", L), ("number", I), ("state", S), ("comments", I),
    ("created_at", TS), ("issue_text", S), ("clean_issue_text", S),
)

QUALITY_ATTRIBUTES_V2 = _schema(("attribute", S), ("definition", S))

GROUND_TRUTH = _schema(
    ("issue_id", L), ("attribute_id", I), ("is_related", D), ("relevant_contents", S), ("label", S),
)

TRACKER = _schema(("project_id", L), ("last_issue_id", L))

MENTIONS = _schema(
    ("project_id", L), ("criteria", S), ("semantic", S), ("similarity_score", D), ("issue_id", L),
)

MATCHES = _schema(
    ("project_id", L), ("attribute", S), ("sentiment", S), ("similarity_score", D), ("issue_id", L),
    ("reason", S),
)

LABELLED = _schema(
    ("issue_id", L), ("project_id", L), ("attribute_id", I), ("nli_label", S), ("nli_json", S),
)

METRICS = _schema(
    ("attribute_id", I), ("attribute", S), ("model", S), ("chunking_strategy", S),
    ("threshold_config", S), ("hypothesis_version", S), ("max_tokens", I), ("aggregation_logic", S),
    ("duration_seconds", D), ("precision", D), ("recall", D), ("specificity", D), ("accuracy", D),
    ("f1_score", D),
)
SCORE_METRICS_KEY = [
    "attribute_id", "model", "chunking_strategy", "threshold_config", "hypothesis_version",
    "max_tokens", "aggregation_logic",
]
VOTE_METRICS_KEY = [
    "attribute_id", "model", "chunking_strategy", "threshold_config", "hypothesis_version",
    "aggregation_logic",
]

