"""Files of the stages: rasters, vector layers, region JSON, track tables."""
