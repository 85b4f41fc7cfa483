"""tidemark: event-ledger analytics expressed as PySpark DataFrame jobs."""
