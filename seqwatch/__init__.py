"""seqwatch: analytics over labelled action sequences, on Spark."""
