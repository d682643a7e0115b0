"""Whole alignments as plans over the operators, and the fixture networks that queries run on."""
