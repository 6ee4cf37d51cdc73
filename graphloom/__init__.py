"""graphloom: a code-graph analytics engine on PySpark DataFrames."""
