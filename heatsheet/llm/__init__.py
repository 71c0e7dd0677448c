"""Operators for preparing training data: filters, deduplication, packing, token files.

Every operator is a function from DataFrames to a DataFrame. Nothing outside this
package imports it.
"""
