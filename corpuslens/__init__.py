"""Labelled media corpora and detector scores as Spark DataFrames."""

import sys

from pyspark import cloudpickle

from corpuslens.session import build_session, workspace

# Task functions travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "workspace"]
