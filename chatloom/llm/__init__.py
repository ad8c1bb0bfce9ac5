"""Operators for training corpora: personal data, toxicity, languages, duplicates, mixing, packing."""

import chatloom
from pyspark import cloudpickle

# Python stages carry their code along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(chatloom)
