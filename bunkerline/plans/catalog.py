"""Importing this module registers every query."""

from bunkerline.plans import energy, fitting, ingest, panel, planning  # noqa: F401

FLAGSHIP = "flagship_class_period"
