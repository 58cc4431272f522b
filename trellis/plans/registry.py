"""Modules of this package that hold queries (``QUERIES``) and their SQL (``SQL``)."""

from __future__ import annotations

from trellis.plans import building, general, retrieval, structure


def modules() -> list:
    return [general, structure, retrieval, building]
