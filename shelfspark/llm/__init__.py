"""Training-data operators: dedup, decontamination, scoring, mixing, formatting.

Nothing else in the library imports this subpackage; its queries and SQL are in
``queries.py`` and the staged corpus pipeline is ``corpus_pipeline.py`` at the
repository top.
"""
