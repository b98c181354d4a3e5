"""lexengine: dictionary lookup and text analytics on Spark DataFrames."""
