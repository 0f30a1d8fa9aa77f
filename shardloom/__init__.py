"""shardloom: sharded tables and large-scale data processing on PySpark."""
