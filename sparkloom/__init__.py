"""Sparkloom: corpus curation and analysis for language-model training, on Spark DataFrames."""
