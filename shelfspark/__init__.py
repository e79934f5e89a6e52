"""Catalog retrieval analytics expressed as Spark DataFrame transformations.

Sub-packages
------------
functions   Column -> Column helpers (text cleaning, tokens, vector maths).
sources     Readers and writers (CSV/JSON catalogs, media, vector collections).
operators   DataFrame -> DataFrame operators (ids, k-NN, profiling, encoding,
            evaluation, chat logs).
plans       End-to-end pipelines composed from the operators.
streaming   Structured Streaming forms of the incremental operators.
"""

from shelfspark.session import get_session, checkpoint_root

__all__ = ["get_session", "checkpoint_root"]
