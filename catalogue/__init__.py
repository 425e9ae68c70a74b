"""The registered queries: each operator over the driver tables, with its SQL twin."""

from importlib import import_module

_MODULES = (
    "log", "folding", "reach", "statistics", "board", "sweeps", "nudging", "text", "screening", "resolution", "privacy", "account", "evaluation", "streams", "sources",
)


def _load():
    queries, oracles = {}, {}
    for name in _MODULES:
        module = import_module(f"catalogue.{name}")
        clash = set(queries) & set(module.REGISTRY.queries)
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        queries.update(module.REGISTRY.queries)
        oracles.update(module.REGISTRY.oracles)
    return queries, oracles


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
