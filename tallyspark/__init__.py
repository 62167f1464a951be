"""Business-report analytics over sales, orders, inventory and returns feeds, as Spark DataFrame operators."""
