"""Training-data operators: one module each, built on the DataFrame API.

Nothing outside this folder imports it.
"""
