"""Analytics over configuration documents on Spark."""
