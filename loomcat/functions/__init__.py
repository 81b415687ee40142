"""Column builders. Every rule here is a native expression; none is a Python UDF.

Rules name their input as few times as they can, often through one pattern. The optimizer pushes a
filter on a derived column down to the scan by writing the derivation out, so an input named four
times at each of four steps would be evaluated in 256 places.
"""
