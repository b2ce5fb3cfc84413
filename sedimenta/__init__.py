"""Sedimenta: deterministic analytics over versioned entities and event streams, as Spark plans."""
