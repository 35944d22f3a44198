"""A strict, typed table engine on Spark DataFrames."""

from importlib import import_module

__version__ = "0.1.0"

_HOMES = {
    "ParseError": "errors", "ColumnType": "types",
    **dict.fromkeys(("Column", "Condition", "Frame", "GroupBy", "from_dict", "from_spark", "parse_csv", "read_csv"), "frame"),
}

__all__ = [*_HOMES, "__version__", "version"]


def __getattr__(name: str):
    """Names come when they are asked for: workers that unpickle a function of one module don't load the facade."""
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)


def version() -> str:
    return __version__
