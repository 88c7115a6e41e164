"""Registered queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

from .registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
