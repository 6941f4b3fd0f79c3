"""tessera: a Spark-native analytics engine for code graphs, program dependence, findings and event logs."""
