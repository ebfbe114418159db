"""Projections that turn raw documents into typed columns.

Every operator here is a single ``select`` built from ``df.schema`` on the
driver (metadata only), so Catalyst sees one Project, prunes unused columns
down to the scan and keeps everything in whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# The precision a bare ``decimal`` target type gets (H2).  Spark alone would
# read it as decimal(10,0) and turn 0.5 into 1; the document-store mapping
# library is believed to default to (10,2).
BARE_DECIMAL = "decimal(10,2)"

Mapping4 = tuple[str, str, str, str]


def _lookup(names: Iterable[str], name: str) -> str | None:
    """Case-insensitive column lookup (Spark's default resolution)."""
    low = name.lower()
    for n in names:
        if n.lower() == low:
            return n
    return None


def flatten_struct(df: DataFrame, root: str = "data") -> DataFrame:
    """Every field of struct ``root`` becomes a root column named in lower
    case, and ``root`` is dropped.

    A nested field whose name equals a root column case-insensitively replaces
    that column in place (taking the nested name in lower case); the other
    nested fields are appended in their struct order.  Of two nested fields
    that collide with each other, the later one wins.
    """
    root_name = _lookup(df.columns, root)
    if root_name is None:
        return df
    dtype = df.schema[root_name].dataType
    if not isinstance(dtype, StructType):
        raise TypeError(f"column {root_name!r} is {dtype.simpleString()}, not a struct")
    # a struct cast goes by position: unique names tell fields apart that differ in case only
    unique = StructType([StructField(f"f{i}", f.dataType) for i, f in enumerate(dtype.fields)])
    nested: dict[str, int] = {}  # lower name -> place (later wins)
    for i, f in enumerate(dtype.fields):
        nested[f.name.lower()] = i
    collides = len(nested) < len(dtype.fields)

    def nested_col(place: int) -> Column:
        if collides:
            return F.col(f"`{root_name}`").cast(unique).getField(f"f{place}")
        return F.col(f"`{root_name}`").getField(dtype.fields[place].name)

    out: list[Column] = []
    used: set[str] = set()
    for c in df.columns:
        if c == root_name:
            continue
        low = c.lower()
        if low in nested:
            out.append(nested_col(nested[low]).alias(low))
            used.add(low)
        else:
            out.append(F.col(f"`{c}`"))
    for low, field in nested.items():
        if low not in used:
            out.append(nested_col(field).alias(low))
    return df.select(*out)


def extract_choice(
    df: DataFrame,
    column: str,
    arm: str = "double",
    strict: bool = True,
    missing_ok: bool = False,
) -> DataFrame:
    """Keep one arm of a multi-typed ("choice") struct column, in place.

    ``strict=True`` is the reference behaviour: values stored in another arm
    become NULL.  ``strict=False`` falls back to the other numeric arms cast to
    the chosen type.  A column that is already a plain value (not a struct) is
    cast to ``arm`` unchanged (H3).  A missing column raises unless
    ``missing_ok`` (documents that never carried the field).
    """
    name = _lookup(df.columns, column)
    if name is None:
        if missing_ok:
            return df
        raise ValueError(f"no column {column!r}")
    dtype = df.schema[name].dataType
    if isinstance(dtype, StructType):
        arms = [f.name for f in dtype.fields]
        chosen = _lookup(arms, arm)
        if chosen is None:
            value = F.lit(None).cast(arm)
        else:
            value = F.col(f"`{name}`").getField(chosen)
        if not strict:
            others = [F.col(f"`{name}`").getField(a).cast(arm) for a in arms if a != chosen]
            value = F.coalesce(value, *others)
    else:
        value = F.col(f"`{name}`").cast(arm)
    return df.select(
        *[value.alias(name) if c == name else F.col(f"`{c}`") for c in df.columns]
    )


def _source(df: DataFrame, path: str) -> Column | None:
    """Resolve a possibly dotted, case-insensitive source path; None if absent."""
    parts = path.split(".")
    top = _lookup(df.columns, parts[0])
    if top is None:
        return None
    col = F.col(f"`{top}`")
    dtype = df.schema[top].dataType
    for p in parts[1:]:
        if not isinstance(dtype, StructType):
            return None
        field = _lookup(dtype.fieldNames(), p)
        if field is None:
            return None
        col = col.getField(field)
        dtype = dtype[field].dataType
    return col


def _target_type(t: str, bare_decimal: str) -> str:
    return bare_decimal if t.strip().lower() == "decimal" else t


def apply_mapping(
    df: DataFrame,
    mappings: Sequence[Mapping4],
    *,
    bare_decimal: str = BARE_DECIMAL,
    lenient: bool = False,
    strict: bool = False,
    fill: bool = False,
) -> DataFrame:
    """Ordered ``(source, source_type, target, target_type)`` rename+cast.

    Sources may be dotted paths into structs (``data.country``) and resolve
    case-insensitively.  Columns not listed are dropped.  A source missing from
    the schema is skipped (``strict=True`` raises instead, ``fill=True`` gives
    its target as typed NULLs, so that every target exists).  Casts follow ANSI
    rules (overflow raises); ``lenient=True`` uses ``try_cast`` (NULL instead).
    """
    out: list[Column] = []
    for src, _src_type, dst, dst_type in mappings:
        col = _source(df, src)
        if col is None:
            if strict:
                raise ValueError(f"mapping source {src!r} not in schema")
            if not fill:
                continue
            col = F.lit(None)
        t = _target_type(dst_type, bare_decimal)
        out.append((col.try_cast(t) if lenient else col.cast(t)).alias(dst))
    return df.select(*out)


def residual_mappings(df: DataFrame, static: Iterable[str]) -> list[Mapping4]:
    """A ``string -> string`` mapping, lower-cased, for every column not in
    ``static`` (compared in lower case)."""
    fixed = {s.lower() for s in static}
    return [
        (c.lower(), "string", c.lower(), "string")
        for c in df.columns
        if c.lower() not in fixed
    ]


def residual_to_string(df: DataFrame, static: Iterable[str]) -> DataFrame:
    """P4 alone: keep only the non-static columns, lower-cased, as strings."""
    return apply_mapping(df, residual_mappings(df, static))


def cast_date(
    df: DataFrame, column: str = "date", fmt: str = "yyy/MM/dd", strict: bool = False
) -> DataFrame:
    """Text date -> timestamp in place.  ``strict`` raises on bad input
    (ANSI ``to_timestamp``); the default gives NULL (``try_to_timestamp``)."""
    name = _lookup(df.columns, column)
    if name is None:
        return df
    src = F.col(f"`{name}`")
    # Wall-clock timestamp (no zone), like the BI DATETIME it stands for.
    value = (
        F.to_timestamp(src, fmt) if strict else F.try_to_timestamp(src, F.lit(fmt))
    ).cast("timestamp_ntz")
    return df.select(
        *[value.alias(name) if c == name else F.col(f"`{c}`") for c in df.columns]
    )


# Geographic roles of the report columns.
GEO_ROLES = {"country": "COUNTRY", "province": "STATE"}


def tag_geo(df: DataFrame, roles: Mapping[str, str] = GEO_ROLES) -> DataFrame:
    """Attach a geographic role to columns as column metadata."""
    for column, role in roles.items():
        name = _lookup(df.columns, column)
        if name is not None:
            df = df.withMetadata(name, {"geographic_role": role})
    return df


def geo_roles(df: DataFrame) -> dict[str, str]:
    """Read back the roles set by ``tag_geo``."""
    return {
        f.name: f.metadata["geographic_role"]
        for f in df.schema.fields
        if "geographic_role" in f.metadata
    }
