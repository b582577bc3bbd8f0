"""A row-cleansing and upsert engine on Spark DataFrames."""
