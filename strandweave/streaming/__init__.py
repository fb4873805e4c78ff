"""No operator of this library is a streaming one: what it replaces works on whole files, and has no state, watermark or window.

The per-read operators of `strandweave.operators.reads` (trimming, filtering, both strands) are plain projections and
filters, and take a streaming DataFrame as they are.
"""
