"""Named queries over the standard tables; importing this package registers them all."""

from importlib import import_module
from pkgutil import iter_modules

from .registry import QUERIES, SQL

for _module in iter_modules(__path__):
    if _module.name != "registry":
        import_module(f"{__name__}.{_module.name}")

__all__ = ["QUERIES", "SQL"]
