"""rankpulse: ranked-list analytics and corpus operators as PySpark DataFrames."""
