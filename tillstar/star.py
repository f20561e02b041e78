"""The star: one sales fact and four dimensions, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class Star:
    fact: DataFrame        # fact_sales
    customers: DataFrame   # dim_customers
    products: DataFrame    # dim_products
    stores: DataFrame      # dim_stores
    time: DataFrame        # dim_time
    hour_epoch_keys: bool = False   # time_sk is calendar.hour_key (known without reading dim_time)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "fact_sales": self.fact,
            "dim_customers": self.customers,
            "dim_products": self.products,
            "dim_stores": self.stores,
            "dim_time": self.time,
        }

    def register_views(self) -> None:
        """Expose the five tables as temp views for ``spark.sql``."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)

    def persist(self) -> "Star":
        """Keep the tables in executor memory/disk for repeated queries
        (the dashboard's result reuse).  Returns a new Star of persisted frames."""
        from pyspark import StorageLevel

        return Star(**{k: v.persist(StorageLevel.MEMORY_AND_DISK) for k, v in self._fields().items()},
                    hour_epoch_keys=self.hour_epoch_keys)

    def unpersist(self) -> None:
        for df in self._fields().values():
            df.unpersist()

    def _fields(self) -> dict[str, DataFrame]:
        return {"fact": self.fact, "customers": self.customers, "products": self.products,
                "stores": self.stores, "time": self.time}
