"""Analytics over versioned block logs, written as Spark plans."""
