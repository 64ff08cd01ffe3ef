"""Registered queries, one module per operator family."""

import importlib

FAMILIES = (
    "ingest", "records", "joins", "integrity", "splits", "calibrate", "metrics", "resample", "audits", "rules",
    "arrays", "retrieval", "streams",
)


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"plumbline.plans.q_{family}")
