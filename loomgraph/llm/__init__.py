"""Operators for training data made from code and the texts around it.

Optional: nothing else in loomgraph imports this subpackage.
"""
