"""Sinks: committed appends, snapshots, ledgers, exports and reports."""
