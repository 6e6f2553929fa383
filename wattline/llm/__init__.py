"""Operators of a training-data pipeline: cleaning, near duplicates, decontamination, classifiers, formatting and packing.

Nothing else in the library imports this subpackage.  Every operator takes and returns DataFrames; the registered queries stand in
`queries.py` with their SQL where SQL can express them.
"""
