"""lexweave: entity-aware text analytics and corpus preparation as PySpark DataFrame operators."""
