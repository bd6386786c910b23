"""Training-data operators: dedup, filtering, mixing, packing and file formats for corpora.

Self-contained: nothing outside this folder imports it.
"""
