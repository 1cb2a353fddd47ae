"""outline_ledger: flatten outline-structured accounting registers with Spark.

Every operator is a ``DataFrame -> DataFrame`` function over an ordered table
(file, row order); see ``operators.ordered.RowOrder``.
"""

from .operators.ordered import RowOrder  # noqa: F401

__all__ = ["RowOrder"]
