"""spanframe: distributed analytics over genome interval layers, on PySpark DataFrames.

Every public operator takes DataFrames and returns a DataFrame; nothing is
collected, and every operator runs over whole tables (all chromosomes, all
sequences, all genes) in one Spark job.
"""

__version__ = "0.1.0"
