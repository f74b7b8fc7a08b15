"""Queries registered over the driver's tables, by theme."""

from __future__ import annotations

from importlib import import_module

from marginalia.catalog.registry import ORACLES, QUERIES

THEMES = ("select_queries", "walk_queries", "score_queries", "chat_queries", "io_queries")


def _load() -> None:
    for theme in THEMES:
        import_module(f"marginalia.catalog.{theme}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
