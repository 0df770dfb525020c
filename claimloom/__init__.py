"""An evidence-weighted, bitemporal claims engine on Spark DataFrames."""
