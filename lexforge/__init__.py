"""lexforge: a Spark-native engine for digitised dictionaries and the texts about them."""

from lexforge.session import read_table, tune

__all__ = ["read_table", "tune"]
