"""Multi-step jobs, the registered queries and their SQL oracles."""
