"""rasterloom: gridded and attribute-table analytics as Spark DataFrame operators."""
