"""A DataFrame with the query language's types and what is known of its row order."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .typed import Typed, type_of

ORDER = "__order"
#: Start of the hidden columns that hold what a dynamic column's text was made from.
PARTS = "__parts_"


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Frame:
    """``types``: the visible columns in order.  ``keys``: hidden columns that part the rows, in
    ``partition`` and ``mv-apply``.  ``order``: (column, ascending) of a sort that still holds."""

    df: DataFrame
    types: dict[str, str]
    keys: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    marks: dict = field(default_factory=dict)
    #: The DataFrame that has parts of dynamic columns; one made from it has other rows or columns, and they are parsed again.
    parts: DataFrame | None = None
    sizes: dict[str, int | None] = field(default_factory=dict)

    @property
    def names(self) -> dict[str, Typed]:
        if self.parts is not self.df:
            return {n: Typed(ref(n), k) for n, k in self.types.items()}
        kept = set(self.df.columns)
        part = lambda n, what: ref(f"{PARTS}{what}_{n}") if f"{PARTS}{what}_{n}" in kept else None
        return {n: Typed(ref(n), k, jsons=part(n, "jsons"), nums=part(n, "nums"), size=self.sizes.get(n)) for n, k in self.types.items()}

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.types and not c.startswith(PARTS)]

    def select(self, columns: dict[str, Typed], **changes) -> Frame:
        """These columns and the hidden ones."""
        found = [(f"{PARTS}{what}_{n}", getattr(x, what)) for n, x in columns.items() for what in ("jsons", "nums")]
        parts = [c.alias(n) for n, c in found if c is not None]
        df = self.df.select(*[x.col.alias(n) for n, x in columns.items()], *[ref(h) for h in self.hidden if h not in columns], *parts)
        order = self.order if all(n in columns for n, _ in self.order) else ()
        return replace(self, df=df, types={n: x.type for n, x in columns.items()}, order=changes.pop("order", order), parts=df if parts else None, sizes={n: x.size for n, x in columns.items()}, **changes)

    def with_df(self, df: DataFrame, **changes) -> Frame:
        return replace(self, df=df, **changes)

    def sort_columns(self) -> list[Column]:
        return [ref(n).asc_nulls_first() if asc else ref(n).desc_nulls_last() for n, asc in self.order]

    def numbered(self) -> Frame:
        """With a hidden column that tells the rows' order as they come, where no sort does."""
        if self.order or ORDER in self.df.columns:
            return self
        return self.with_df(self.df.withColumn(ORDER, F.monotonically_increasing_id()))

    def window(self) -> WindowSpec:
        """Rows in order, within the parting keys.  Call on a ``numbered`` frame."""
        by = self.sort_columns() + ([ref(ORDER)] if ORDER in self.df.columns else [])
        spec = W.partitionBy(*map(ref, self.keys)) if self.keys else W.partitionBy(F.lit(0))
        return spec.orderBy(*by)

    def visible(self) -> DataFrame:
        return self.df.select(*map(ref, self.types))


def from_spark(df: DataFrame, types: dict[str, str] | None = None) -> Frame:
    """A frame of any DataFrame: structs, maps and arrays become JSON text, whole numbers longs, and so on."""
    kinds, cols = {}, []
    for f in df.schema.fields:
        kind = types[f.name] if types and f.name in types else type_of(f.dataType)
        kinds[f.name] = kind
        c, name = ref(f.name), f.dataType.typeName()
        if kind == "dynamic" and name != "string":
            c = F.to_json(c) if name == "variant" else F.to_json(F.to_variant_object(c)) if name in ("array", "map", "struct") else c
        elif kind in ("long", "int", "timespan") and name != "long":
            c = c.cast("bigint")
        elif kind == "real" and name != "double":
            c = c.cast("double")
        elif kind == "datetime" and name != "timestamp":
            c = c.cast("timestamp")
        elif kind == "string" and name != "string":
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return Frame(df.select(*cols), kinds)
