"""Training-data pipeline operators on Spark.

Thirteen operators over ``documents``, ``pages``, ``embeddings``, ``labels`` and
``conversations``; the registered queries are in ``queries.py``. Nothing else
in the library imports this subpackage.
"""
