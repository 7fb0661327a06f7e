"""All queries of the reference operators by name, and their SQL."""

from tallyloom.plans import flows, stores, streams, structure, telemetry

MODULES = (telemetry, stores, structure, flows, streams)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
