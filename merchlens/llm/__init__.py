"""Operators for preparing product texts as training data, with their queries.

Nothing else in the library imports this package; ``__spark_entry__.py`` adds its queries only
where it is present.
"""
