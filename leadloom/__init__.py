"""leadloom: a Spark-first engine for turning web pages and listings into clean leads."""
