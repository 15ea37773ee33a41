"""Operators for training-data pipelines over ``documents``.

Each module holds one operator with its general interface; ``queries``
applies them to the given tables.  Nothing outside this package imports it.
"""
