"""All registered queries."""

from querybook import metrics_queries, episode_queries, survey_queries, drift_queries, model_queries, source_queries, scored_queries  # noqa: F401
