"""ridgeline: survey-style regression workbench on Spark DataFrames.

Subpackages: ``sources`` (scans and sinks), ``functions`` (column helpers,
fixed values, distribution tails), ``operators`` (wrangling, splits,
GRAM/HIST kernels and the models on them), ``plans`` (fixture frames,
flagship and the registered query catalogue), ``streaming`` (empty: the
reference has no streaming operators).
"""

__version__ = "0.1.0"
