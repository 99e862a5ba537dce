"""DataFrame operators for legislative and civic data on Apache Spark."""
