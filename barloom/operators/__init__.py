"""Table operators on bars, signals, ledgers and lineage."""
