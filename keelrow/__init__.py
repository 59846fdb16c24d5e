"""keelrow: table contracts, evolution and exchange on Spark DataFrames."""

from keelrow.contract import Column, ForeignKey, Index, TableContract

__all__ = ["Column", "ForeignKey", "Index", "TableContract"]
