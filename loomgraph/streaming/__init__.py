"""streaming of loomgraph."""
