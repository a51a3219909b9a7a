"""Python functions go to executors by value, so that these need no copy of this library."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    """From now on the module's functions and classes are pickled with their code.

    What such a function names from its module is pickled with it, a module that it names with all that is in it; so
    it should name plain functions, constants and modules that have only these.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)
