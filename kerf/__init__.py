"""Material removal as set-based Spark queries.

Stock is a lattice of cells, a toolpath a table of commands. Commands become
segments, segments become primitives (spheres, cylinders, capsules), and what is left
of the part, its distance field and its surface are joins and aggregates over them.
"""
