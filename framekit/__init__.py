"""framekit: a pandas-style dataframe engine planned and run by Spark."""
