"""Operators for training-data pipelines, one module a problem.

names        p1  variant spellings of names
survivors    p2  best representative of each duplicate group
confusables  p3  visually identical text
matching     p4  entities across sources without keys
vocabulary   p5  free values to a canonical list
scans        p6  noise in text from scanned pages
components   p7  pairwise matches into groups
packing      p8  items into containers of fixed capacity
mixing       p9  sources to target weights
templates    p10 template residue and error pages

queries.py names their queries; sql.py holds the SQL of those that have any.
"""
