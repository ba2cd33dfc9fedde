"""Training-data operators: one module per operator, numpy kernels shared through ``kernels``.

Nothing outside this package imports it.
"""
