"""A Spark-first engine that turns long conversations into audited, cost-aware facts and decisions."""
