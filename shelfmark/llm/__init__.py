"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it. Each module holds one operator; ``queries``
registers one query per operator and the corpus pipeline.
"""
