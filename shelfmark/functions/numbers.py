"""Rounding of binary doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark.functions.text import let


def round_exact(c: Column, digits: int) -> Column:
    """Round the exact binary value half to even, e.g. 6.55 -> 6.5.

    ``bround`` works on the printed decimal, where 6.55 looks like a tie although
    the stored value lies below it.  Near a tie the product with ``2 * 10^digits``
    is taken in two parts, a 24-bit head and the rest, whose products are exact,
    so the sign of their sum tells the side.
    """
    scale = float(2 * 10 ** digits)

    def nearest(x: Column) -> Column:
        half_steps = F.rint(x * scale)
        tie = (F.abs(x * scale - half_steps) < 1e-6) & (F.abs(half_steps % 2) == 1)
        head = x.cast("float").cast("double")
        side = (head * scale - half_steps) + (x - head) * scale
        return (F.when(tie & (side > 0), (half_steps + 1) / scale)
                .when(tie & (side < 0), (half_steps - 1) / scale)
                .otherwise(F.bround(x, digits)))

    return let(c.cast("double"), nearest)
