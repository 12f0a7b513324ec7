"""inkgauge: document-image quality at scale, as Spark DataFrames.

``operators``  relational operators over metric rows and pixel relations
``functions``  column expressions (rounding, presets, thresholds, rules)
``plans``      whole pipelines and the registered queries
``sources``    readers and writers
``streaming``  the stateless plan on streams, windowed roll-ups
``llm``        training-data operators; nothing outside imports it
"""

import sys as _sys

from pyspark import cloudpickle as _pickle

# Kernels travel with their tasks, so executors need no copy of this package.
_pickle.register_pickle_by_value(_sys.modules[__name__])
