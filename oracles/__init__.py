"""SQL that an ANSI engine runs on the same tables, to compare results."""

from __future__ import annotations


def all_oracles() -> dict[str, str]:
    import importlib
    import pkgutil

    out: dict[str, str] = {}
    for module in pkgutil.iter_modules(__path__):
        loaded = importlib.import_module(f"{__name__}.{module.name}")
        out.update(getattr(loaded, "ORACLES", {}))
    return out
