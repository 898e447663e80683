"""Analytics over crawled web pages on PySpark."""
