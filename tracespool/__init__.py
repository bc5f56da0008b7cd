"""Analytics for force-spectroscopy traces, written as plain Spark DataFrame jobs.

A *sample table* holds one row per sample with ``trace`` (id), ``i`` (0-based
position), ``n`` (length of the trace) and ``chunk`` (``i div rows``).  The pair
``(trace, chunk)`` is the unit Spark distributes, so one very long trace is spread
over many tasks; see :mod:`tracespool.plans.layout`.
"""
import sys

from pyspark import cloudpickle

# Ship the package's task functions with the job: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
