"""lexgrove: a Spark-native engine over trees of citable provisions.

Every operator is DataFrame -> DataFrame or Column -> Column.
"""
