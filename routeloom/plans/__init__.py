"""Registered queries, one for each operator, with their oracle SQL."""

from __future__ import annotations

from routeloom.plans import augmentations, checks, evaluation, generation, replies, routing, summaries, texts, utterances

_MODULES = (routing, evaluation, texts, utterances, checks, summaries, generation, replies, augmentations)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
