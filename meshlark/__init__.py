"""Structure analytics on Spark: meshes, range joins, spectra, catalogs, ensembles and evolution as DataFrames."""
