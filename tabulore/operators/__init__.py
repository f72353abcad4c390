"""The leaf relation and the aggregations over it."""
