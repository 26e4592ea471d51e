"""Building fine-tuning datasets with Spark DataFrames."""

import sys

from pyspark import cloudpickle

from seedloom.prompts import PromptSet
from seedloom.templates import TemplateRegistry

# The few functions that run in Python workers travel by value, so the package
# has to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PromptSet", "TemplateRegistry"]
