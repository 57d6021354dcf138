"""The five canonical tables, their fixed column types, and the planning parameters."""
from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRICE = T.DecimalType(12, 4)
MONEY = T.DecimalType(14, 2)


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


WAREHOUSES = _schema(("warehouse_id", T.StringType()), ("warehouse_name", T.StringType()), ("region", T.StringType()))
PRODUCTS = _schema(
    ("product_id", T.StringType()), ("product_name", T.StringType()), ("category", T.StringType()),
    ("unit_cost", PRICE), ("unit_price", PRICE), ("lead_time_days", T.IntegerType()),
)
INVENTORY = _schema(
    ("warehouse_id", T.StringType()), ("product_id", T.StringType()),
    ("current_stock", T.IntegerType()), ("reorder_level", T.IntegerType()),
)
RESTOCKS = _schema(
    ("restock_date", T.DateType()), ("warehouse_id", T.StringType()),
    ("product_id", T.StringType()), ("quantity", T.IntegerType()),
)
SALES = _schema(
    ("order_id", T.StringType()), ("order_date", T.DateType()), ("warehouse_id", T.StringType()),
    ("product_id", T.StringType()), ("quantity", T.IntegerType()), ("unit_price", PRICE), ("revenue", MONEY),
)

TABLE_SCHEMAS = {
    "warehouses": WAREHOUSES, "products": PRODUCTS, "inventory": INVENTORY, "restocks": RESTOCKS, "sales": SALES,
}
TABLE_NAMES = tuple(TABLE_SCHEMAS)
PAIR = ["warehouse_id", "product_id"]


@dataclass(frozen=True)
class Tables:
    """The canonical table set; every member is a lazy DataFrame."""

    warehouses: DataFrame
    products: DataFrame
    inventory: DataFrame
    restocks: DataFrame
    sales: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]

    def with_(self, **changes: DataFrame) -> "Tables":
        return replace(self, **changes)


@dataclass(frozen=True)
class Policy:
    """Planning assumptions of the replenishment model."""

    z: float = 1.65
    ordering_cost: float = 50.0
    holding_rate: float = 0.20
    lead_time_extra_days: float = 0.0


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the canonical columns in order, with their canonical types; a value that its type cannot hold is null."""
    return df.select([df[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields])
