"""sievecrest: dataset and classifier auditing on PySpark DataFrames."""
