"""Spark-native signatures of spatial units, their strata, and the choice of representative sites."""
