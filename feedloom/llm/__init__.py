"""Operators for preparing training data from the feed's tables; nothing outside this folder imports them."""

from feedloom.llm.entries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
