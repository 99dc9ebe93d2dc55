"""Operations of a large-scale training-data pipeline.

Ten operators, each a function from DataFrames to a DataFrame, plus ``queries`` (their ``opN_`` queries
and SQL). Nothing else in the library imports this package.
"""
