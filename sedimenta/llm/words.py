"""Word kernels over UTF-8 bytes: split, hash and slide over words in numpy, many texts at once; see functions.hashing."""

from __future__ import annotations

from sedimenta.functions.hashing import SLICE_BYTES, Hasher, Powers, mix, slices, split

__all__ = ["SLICE_BYTES", "Hasher", "Powers", "mix", "slices", "split"]
