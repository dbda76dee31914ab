"""Incident analytics on Spark: cleaning, risk, hotspots, deployment, anomalies."""
