"""Multi-step work: evolving tables, and the ledger of runs."""
