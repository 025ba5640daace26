"""Analytics over message corpora as Spark plans."""
