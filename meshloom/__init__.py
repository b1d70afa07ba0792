"""Federated graph analytics on Spark: graph data that is split over many owners, as DataFrame and SQL plans."""
