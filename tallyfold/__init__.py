"""Record, text-line, lineage and ledger analytics on PySpark DataFrames."""
