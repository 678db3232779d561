"""tabflow: data operators for tabular, survey and event-sequence modelling on Spark DataFrames."""
