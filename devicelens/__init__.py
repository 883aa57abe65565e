"""Device-telemetry analytics as PySpark DataFrame operators.

Every public function takes DataFrames and returns a DataFrame.  The batch
operators live in ``operators``, scalar column helpers in ``functions``,
readers and writers in ``sources``, Structured Streaming jobs in
``streaming`` and the named rules (recording rules, dashboards, alerts) in
``plans``.  ``catalog`` registers each of them over the driver tables together
with the DuckDB SQL it is checked against.
"""
