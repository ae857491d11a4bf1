"""Retrieval and analytics over large text and code corpora, on Spark."""

from corpusq.session import build_session

__all__ = ["build_session"]
