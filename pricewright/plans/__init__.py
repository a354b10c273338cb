"""Composed pipelines (build, train, evaluate, score) and the query registry."""
