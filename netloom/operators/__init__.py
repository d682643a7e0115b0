"""Operators on network tables. nodes(id, x, y, ...), edges(src, dst, ...), candidates(g1_id, g2_id, distance)."""
