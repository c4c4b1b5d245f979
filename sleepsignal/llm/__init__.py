"""Operators of a large training-data pipeline: texts, archives, packing, classifiers, joins, indexes."""
