"""Document and news intelligence as PySpark table operators.

Every operator takes DataFrames and returns DataFrames, so the whole library composes with
``DataFrame.transform`` and Catalyst plans the result as one query.
"""
