"""Training-data operators: ten corpus operators, their thin ``opN_`` queries and SQL.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
``queries()`` and ``oracle_sql()`` from ``corvane.llm.queries`` when it is present.
"""
