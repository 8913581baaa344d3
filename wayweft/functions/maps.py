"""Maps, namespaces of attribute keys, and defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayweft.functions.geom import UNITS

SEPARATOR = "$"


def namespace(name: str) -> str:
    """Prefix of a client's attributes; that of the network's own is network_namespace()."""
    return name + SEPARATOR


def network_namespace(name: str) -> str:
    return f"{name}_pnwk{SEPARATOR}"


def merge(left: Column, right: Column) -> Column:
    """Both maps, the right one winning, independent of the session's policy for duplicate keys. Null maps are empty."""
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.map_concat(kept, right))


def add_prefix(tags: Column, prefix: str) -> Column:
    return F.transform_keys(tags, lambda k, _: F.concat(F.lit(prefix), k))


def drop_prefix(tags: Column, prefix: str) -> Column:
    """Without the keys of a namespace."""
    return F.map_filter(tags, lambda k, _: ~k.startswith(prefix))


def only_keys(tags: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(tags, lambda k, _: k.isin(list(keys)))


def split_key(key: Column) -> Column:
    """struct(prefix, name): the prefix ends with the first separator and is empty without one."""
    at = F.locate(SEPARATOR, key)
    return F.struct(F.substring(key, F.lit(1), at).alias("prefix"), F.substring(key, at + 1, F.length(key)).alias("name"))


def get(tags: Column, key: str, default: object = None) -> Column:
    found = F.element_at(tags, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def percent(part: Column, of: Column) -> Column:
    """Rounded percentage; 0 of nothing."""
    return F.when(of == 0, 0).otherwise(F.round(100 * part / of)).cast("long")


def scales(units: str) -> dict[str, float]:
    """Lengths that count as equal, as a street's width and as a block, in map units."""
    from wayweft.functions.geom import BLOCK_M, STEP_M, STREET_M

    if units not in UNITS:
        raise ValueError(f"units are meters or feet, not {units!r}")
    return {"units": UNITS[units], "step": STEP_M * UNITS[units], "street": STREET_M * UNITS[units], "block": BLOCK_M * UNITS[units]}
