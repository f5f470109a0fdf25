"""Structure of numbered documents as DataFrames: labels, outlines, references, validation, rendering."""
