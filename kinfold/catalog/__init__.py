"""Registered queries, one module per operator family."""

from importlib import import_module

FAMILIES = ("sources", "cleaning", "groups", "sequences", "vectors", "splits", "metrics", "reference", "resample", "seeds", "models", "checked_fits", "studies")


def load() -> None:
    """Import every family so that its queries register."""
    for family in FAMILIES:
        import_module(f"kinfold.catalog.{family}")
