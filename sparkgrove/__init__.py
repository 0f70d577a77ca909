"""sparkgrove: adaptive quadtree/octree forests and spatial point data on Spark DataFrames."""
