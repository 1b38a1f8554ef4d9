"""reviewloom: weekly customer-feedback analytics on Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``sources`` (scans and
views), ``operators`` (DataFrame -> DataFrame operators), ``plans`` (the
weekly job, re-draft and the query catalog), ``streaming`` (landing stream).
"""

__version__ = "0.1.0"
