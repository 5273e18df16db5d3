"""quern: a Spark-first analytics engine for agent context, telemetry and training text."""
