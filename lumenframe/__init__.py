"""lumenframe: a PySpark-native analytics engine for imaging datasets.

Sub-packages: ``sources`` (scans, sinks, URIs, manifests), ``functions`` (scalar
expressions), ``operators`` (DataFrame -> DataFrame operators), ``plans``
(queries over the driver tables and pipeline builders), ``streaming``
(Structured Streaming operators).
"""
