"""Validated query trees compiled to lazy Spark DataFrames, and operators over training data in ``sieveframe.llm``."""
