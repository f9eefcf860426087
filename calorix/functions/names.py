"""Names, codes and dotted keys."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def code_to_name(code, names: dict[int, str]) -> Column:
    """Look a code up in a fixed small table; an unknown code gives NULL."""
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in names.items())
    return F.create_map(*pairs)[code if isinstance(code, Column) else F.col(code)]


def identifier(name) -> Column:
    """Make a file stem usable as a table name: dashes and dots become underscores."""
    return F.translate(name if isinstance(name, Column) else F.col(name), "-.", "__")


def run_number_before_extension(name) -> Column:
    """``sample.root.7`` becomes ``sample.7.root``; other names are unchanged."""
    source = name if isinstance(name, Column) else F.col(name)
    return F.regexp_replace(source, r"\.root\.([0-9]+)$", ".$1.root")


def decode_param(value, schema: str = "map<string,string>") -> Column:
    """Decode a logged parameter: the text ``None`` is NULL, JSON is parsed, the rest is text.

    The result is a struct ``(text, json, is_json)`` so that one column type fits every value.
    """
    v = value if isinstance(value, Column) else F.col(value)
    text = F.when(v == "None", F.lit(None).cast("string")).otherwise(v)
    parsed = F.from_json(text, schema)
    is_json = F.try_parse_json(text).isNotNull()
    return F.struct(text.alias("text"), parsed.alias("json"), is_json.alias("is_json"))


def _leaves(field: T.StructField, path: list[str], at: Column, sizes: dict[str, int]):
    dotted = ".".join(path)
    if isinstance(field.dataType, T.StructType):
        for sub in field.dataType.fields:
            yield from _leaves(sub, [*path, sub.name], at.getField(sub.name), sizes)
    elif isinstance(field.dataType, T.ArrayType) and dotted in sizes:
        element = T.StructField("element", field.dataType.elementType)
        for i in range(sizes[dotted]):
            yield from _leaves(element, [*path, str(i)], F.get(at, F.lit(i)), sizes)
    else:
        yield at.alias(dotted)


def flatten_columns(df: DataFrame, array_sizes: dict[str, int] | None = None) -> DataFrame:
    """Open nested structs into dotted columns; arrays with a stated size are indexed too."""
    sizes = array_sizes or {}
    return df.select(
        *[
            leaf
            for f in df.schema.fields
            for leaf in _leaves(f, [f.name], F.col(f"`{f.name}`"), sizes)
        ]
    )


def unflatten_columns(df: DataFrame, separator: str = ".") -> DataFrame:
    """Gather columns named ``a.b.c`` into nested structs, the inverse of flattening."""
    tree: dict = {}
    for name in df.columns:
        *parents, leaf = name.split(separator)
        node = tree
        for part in parents:
            node = node.setdefault(part, {})
        node[leaf] = F.col(f"`{name}`")

    def pack(node: dict) -> list[Column]:
        return [
            (F.struct(*pack(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()
        ]

    return df.select(*pack(tree))


def prefix_columns(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename every column to ``prefix`` + name, except those in ``keep``."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})
