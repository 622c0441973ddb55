"""Spark library for code-model evaluation and fine-tuning data.

Tasks, prompts, completions, scores, corpus subsets and token batches are all
DataFrames; every operator maps DataFrames to DataFrames or Columns to Columns.
"""
