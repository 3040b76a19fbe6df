"""Analytics over ordered series and tables as Spark plans: ``DataFrame -> DataFrame`` and ``Column`` functions."""
