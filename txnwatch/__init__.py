"""txnwatch: transaction monitoring as Spark jobs.

Stages: ``sources`` (raw files and tables), ``operators`` (features, rules,
ranking metrics, sampling, models, attribution), ``plans`` (the pipeline and
the registered queries) and ``functions`` (column expressions).
"""

__version__ = "0.1.0"
