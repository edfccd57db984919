"""Inputs of the engine: directory scans, configuration, change logs, log files, manifests."""
