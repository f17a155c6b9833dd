"""Query registry, catalog and publication plans."""

from __future__ import annotations


def all_queries():
    import importlib
    import pkgutil

    from tallyspark.plans import registry

    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return dict(registry.QUERIES)
