"""PySpark jobs for engineering telemetry, file catalogs, dependency graphs and ownership."""
