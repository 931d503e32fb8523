"""Industrial time-series and traffic analytics expressed as Spark jobs."""
