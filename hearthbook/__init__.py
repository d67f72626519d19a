"""hearthbook: household-ledger analytics as Spark DataFrame plans."""
