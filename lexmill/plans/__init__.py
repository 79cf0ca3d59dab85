"""The query catalogue: each entry has a Spark plan and, where SQL can state it, an oracle."""
