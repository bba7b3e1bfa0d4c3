"""factloom: document fact verification as Spark DataFrame operators."""
