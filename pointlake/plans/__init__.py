"""Checked queries over the base tables."""

from importlib import import_module

from pointlake.plans.registry import REGISTRY, Query

MODULES = ("labels", "metrics", "geometry", "voxels", "vectors", "images", "clusters", "overlaps", "instance_job", "augmentation", "files")


def catalogue() -> dict[str, Query]:
    """All registered queries by name."""
    for name in MODULES:
        import_module(f"pointlake.plans.{name}")
    return REGISTRY
