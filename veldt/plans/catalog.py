"""Imports every query module so the registry is complete."""

import importlib

MODULES = [
    "veldt.plans.q_panel",
    "veldt.plans.q_readmodel",
    "veldt.plans.q_allocate",
    "veldt.plans.q_quality",
    "veldt.plans.q_evaluate",
    "veldt.plans.q_misc",
    "veldt.plans.q_ml",
    "veldt.plans.q_stream",
    "veldt.plans.q_sources",
    "veldt.plans.q_spatial",
    "veldt.plans.q_store",
]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(m)
