"""python wrangle_data.py IN.csv OUT: lower-case and trim every column, cluster similar strings, write CSV with a header."""

import sys

from pyspark.sql import SparkSession

from cellwright.operators.wrangle import wrangle_file

if __name__ == "__main__":
    if len(sys.argv) != 3:
        sys.exit(__doc__)
    wrangle_file(SparkSession.builder.getOrCreate(), sys.argv[1], sys.argv[2])
