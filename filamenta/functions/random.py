"""SplitMix64 as column expressions: the nth number of a seed without those before it.

Products modulo 2^64 are put together from 16-bit limbs, as 64-bit products overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filamenta.functions import geometry as g

#: Fixed values of the generator: step and multipliers.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_LOW = 0xFFFF


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _limbs(x: Column) -> list[Column]:
    return [F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(_LOW)) for k in range(4)]


def _carried(sums: list[Column]) -> Column:
    """The number of four limb sums of less than 2^40, modulo 2^64."""
    out, carry = None, F.lit(0).cast("long")
    for k, s in enumerate(sums):
        whole = s + carry
        limb = F.shiftleft(whole.bitwiseAND(F.lit(_LOW)), 16 * k)
        out, carry = limb if out is None else out.bitwiseOR(limb), F.shiftrightunsigned(whole, 16)
    return out


def times(x: Column, m: int) -> Column:
    """x * m modulo 2^64."""
    b = [m >> 16 * k & _LOW for k in range(4)]
    return g.let(F.array(*_limbs(x)), lambda a: _carried([sum((a[i] * F.lit(b[k - i]) for i in range(k + 1)), F.lit(0).cast("long")) for k in range(4)]))


def plus(x: Column, m: int) -> Column:
    """x + m modulo 2^64."""
    return _carried([a + F.lit(m >> 16 * k & _LOW) for k, a in enumerate(_limbs(x))])


def _mixed(x: Column, shift: int, m: int | None) -> Column:
    y = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return y if m is None else times(y, m)


def splitmix(n: Column, seed: int) -> Column:
    """The number that follows n others of the seed, as a long whose bits are the unsigned number's."""
    state = plus(times(n.cast("long") + 1, STEP), seed % (1 << 64))
    return g.let(state, lambda s: g.let(_mixed(s, 30, FIRST), lambda t: g.let(_mixed(t, 27, SECOND), lambda u: _mixed(u, 31, None))))


def unit(n: Column, seed: int) -> Column:
    """A double of [0, 1) from the upper 53 bits."""
    return F.shiftrightunsigned(splitmix(n, seed), 11) / F.lit(float(1 << 53))


def index(n: Column, seed: int, length: Column) -> Column:
    """The unsigned number modulo a length of less than 2^62."""
    return g.let(splitmix(n, seed), lambda x: ((F.shiftrightunsigned(x, 1) % length) * 2 + x.bitwiseAND(F.lit(1))) % length)
