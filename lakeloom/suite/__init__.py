"""All registered queries and their checking SQL."""

from __future__ import annotations

from importlib import import_module

AREAS = ["transforms", "storage", "semantic", "controls", "records", "scalars", "synthetic", "streams"]


def _load() -> None:
    for area in AREAS:
        import_module(f"lakeloom.suite.{area}")


def all_queries() -> dict:
    _load()
    from lakeloom.suite.base import QUERIES

    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    from lakeloom.suite.base import ORACLES

    return dict(ORACLES)
