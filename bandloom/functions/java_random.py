"""The public linear congruential generator behind java.util.Random."""

from __future__ import annotations


class JavaRandom:
    """Same draws as java.util.Random for the same seed."""

    _MULTIPLIER, _MASK = 0x5DEECE66D, (1 << 48) - 1

    def __init__(self, seed: int):
        self._state = (seed ^ self._MULTIPLIER) & self._MASK

    def bits(self, n: int) -> int:
        self._state = (self._state * self._MULTIPLIER + 0xB) & self._MASK
        return self._state >> (48 - n)

    def next_double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) / (1 << 53)
