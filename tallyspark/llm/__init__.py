"""Training-data pipeline operators.

Nothing else in the library imports this subpackage; its queries are listed in
``tallyspark.llm.queries``.
"""
