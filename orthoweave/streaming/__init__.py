"""Incremental forms of the network scans."""
