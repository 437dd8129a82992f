"""gridloom: gridded elevation data and its feature, edit and ephemeris tables as Spark DataFrames."""
