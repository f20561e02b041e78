"""tillstar: retail star-schema analytics on Spark.

Conform raw order, product, customer and store tables into a sales star,
check it, and answer sales questions with built-in Spark operators.
"""

from tillstar.star import Star

__all__ = ["Star"]
