"""loamline: curation, splitting, scoring and resampling analytics on PySpark DataFrames."""
