"""The three stages as whole plans: extract, curate, render; each ends in DataFrames or bounded tables."""
