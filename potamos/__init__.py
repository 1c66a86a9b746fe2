"""Analytics over river networks and cell grids on Spark DataFrames."""
