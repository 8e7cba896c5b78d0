"""weftgraph: many graph queries over one shared graph, planned and distributed by Spark."""

__version__ = "0.1.0"
