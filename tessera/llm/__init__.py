"""Training-data operators: quality, dedup, decontamination, mixing, scoring.

One module per operator; ``queries`` registers each over the test tables.
Nothing else in the library imports this subpackage.
"""
