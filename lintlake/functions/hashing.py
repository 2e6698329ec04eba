"""Constants of the 32-bit hashes: FNV-1a over UTF-16 code units, and the mixer of the MinHash family."""

from __future__ import annotations

#: Fixed values of the hash functions.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
MIX_STEP, MIX_A, MIX_B = 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35
MASK = 0xFFFFFFFF
SEPARATOR = "\x01"
