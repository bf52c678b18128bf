"""Operators of a large-scale training-data pipeline.

Ten operators and their registered queries (``queries.py``).  Nothing outside this
subpackage imports it; ``__spark_entry__.py`` adds its queries only when it is present.
"""
