"""The queries of this subpackage: one module for each operator adds its own."""

from __future__ import annotations

import importlib

NAMES = (
    "quality",
    "mixing",
    "substring",
    "pii",
    "exact",
    "simhash",
    "decontaminate",
    "warc",
    "urls",
    "extract",
    "topk",
    "negatives",
    "manifest",
)

QUERIES: dict = {}
ORACLES: dict = {}
for _name in NAMES:
    _module = importlib.import_module(f"quadrille.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
