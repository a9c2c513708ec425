"""barwise: time-series and training-data operators expressed as Spark DataFrame plans."""
