"""foldframe: corpus-scale protein-structure analytics on PySpark DataFrames."""
