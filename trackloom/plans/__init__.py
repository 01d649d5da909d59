"""Named queries; importing the query modules fills the registry."""

import importlib

MODULES = [
    "observation_queries",
    "detector_queries",
    "group_queries",
    "protocol_queries",
    "report_queries",
    "series_queries",
    "source_queries",
]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"trackloom.plans.{name}")
