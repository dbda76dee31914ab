"""Named queries over the incident feed, grouped by area."""

import importlib

AREAS = ("basic", "corridors", "deployment", "spatial", "anomaly", "learning")


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"roadwatch.plans.{area}")
