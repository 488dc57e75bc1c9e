"""ledgerloom: layered order analytics and data-difference operators on PySpark DataFrames."""
