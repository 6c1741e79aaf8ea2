"""plans of loomgraph."""
