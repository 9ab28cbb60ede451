"""skyledger: an orbital-catalogue analytics engine written on the PySpark DataFrame API."""
