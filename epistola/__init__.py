"""Correspondence-graph analytics on Spark: text repair, header networks, entity resolution and search."""
