"""Registered queries: relaykit operators run on the driver tables, each with SQL for the same answer."""
