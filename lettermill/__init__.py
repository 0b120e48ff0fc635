"""Message-archive analytics on Spark: manifest algebra, reconciliation, incremental planning and text repair."""
