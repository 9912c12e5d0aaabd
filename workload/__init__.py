"""Registered queries over the given tables, each with independent SQL."""

from . import (registry, text_queries, preference_queries, embedding_queries, statistics_queries,  # noqa: F401
               popularity_queries, request_queries, replay_queries, dataset_queries, dialog_queries,
               source_queries)
