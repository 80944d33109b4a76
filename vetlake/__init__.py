"""Artifact-vetting analytics on Spark DataFrames.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns);
nothing is collected to the driver.  See README.md for the module map.
"""
