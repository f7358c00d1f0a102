"""All registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("wardrobe", "pairs", "outfits", "dataset", "metrics", "audit", "detections", "tags", "jobs")


def load():
    from garderobe.registry import base

    for name in MODULES:
        import_module(f"garderobe.registry.{name}")
    return base.QUERIES, base.ORACLES
