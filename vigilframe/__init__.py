"""vigilframe: entity screening, review ledger and evaluation as Spark DataFrame plans."""
