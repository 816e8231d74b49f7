"""blocklens: Spark-first analytics over append-only, block-structured histories."""
