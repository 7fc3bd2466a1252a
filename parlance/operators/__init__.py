"""Query operators over the news tables; each takes DataFrames and parameters and returns a lazy DataFrame."""
