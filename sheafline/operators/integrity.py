"""Order-sensitive 64-bit fingerprints of integer tables, computed in parallel.

The fingerprint folds bytes one after another: state = (state xor byte) * P
modulo 2^64. As the xor touches only the low byte, each step adds a number that
depends on the low byte alone, so a run of n bytes maps state s to s * P^n + C,
where C depends on s's low byte only. Partitions first report, for each of the
256 low bytes, which low byte comes out; the driver chains those, and then each
partition works out its n and C for the low byte that really comes in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..relation import Relation
from ..runtime import cut

# The start state and the multiplier of the fold.
BASIS = 1469598103934665603
PRIME = 1099511628211
_MASK = (1 << 64) - 1

#: Cells that one task hashes in one go. Beyond that all partitions work at
#: once, at 32 times the work per byte in the first of their two passes.
LOCAL_CELLS = 5_000_000


def checksum(rel: Relation, local_cells: int = LOCAL_CELLS) -> tuple[str, int]:
    """(16 upper-case hexadecimal digits, rows hashed).

    The byte stream holds the number of columns, then for each row its ordinal
    and for each cell the column's number and the value, all as little-endian
    64-bit words, values sign-extended. Only whole-number columns without nulls
    can be hashed; anything else raises TypeError or ValueError.
    """
    if not rel.is_integral():
        raise TypeError("only whole-number columns can be hashed")
    placed = rel.numbered()
    cells = [F.col(f.physical).cast("long").alias(f"v{i}") for i, f in enumerate(placed.fields)]
    rows = cut(placed.df.select(F.col("__ord").alias("o"), *cells))
    width = len(cells)
    if cells and not rows.where(" or ".join(f"v{i} is null" for i in range(width))).isEmpty():
        raise ValueError("nulls cannot be hashed")

    n_rows = rows.count()
    head = np.frombuffer(np.int64(width).tobytes(), np.uint8)
    start = _fold(BASIS, head)
    if n_rows * (1 + width) <= local_cells:

        def whole(batches):
            state = start
            for b in batches:
                for part in _chunks(_bytes(b, width)):
                    c, _ = _affine(part, state & 255)
                    state = (state * pow(PRIME, len(part), 1 << 64) + c) & _MASK
            yield pd.DataFrame({"state": [state.to_bytes(8, "little")]})

        got = rows.coalesce(1).sortWithinPartitions("o").mapInPandas(whole, "state binary").first()
        return f"{int.from_bytes(got[0], 'little') if got else start:016X}", n_rows

    def low_bytes(batches):
        maps, first = np.arange(256, dtype=np.uint8), None
        for b in batches:
            if len(b):
                first = int(b["o"].iloc[0]) if first is None else first
                for part in _chunks(_bytes(b, width)):
                    maps = _low_map(part, maps)
        if first is not None:
            yield pd.DataFrame({"o": [first], "map": [maps.tobytes()]})

    steps = sorted(rows.mapInPandas(low_bytes, "o long, map binary").collect())  # one short row per partition
    state = start
    low, enters = state & 255, {}
    for r in steps:
        enters[r["o"]] = low
        low = r["map"][low]

    def folded(batches):
        n, c, first, low = 0, 0, None, 0
        for b in batches:
            if len(b):
                if first is None:
                    first = int(b["o"].iloc[0])
                    low = enters[first]
                for part in _chunks(_bytes(b, width)):
                    c1, low = _affine(part, low)
                    power = pow(PRIME, len(part), 1 << 64)
                    n, c = n + len(part), (c * power + c1) & _MASK
        if first is not None:
            yield pd.DataFrame({"o": [first], "n": [n], "c": [c.to_bytes(8, "little")]})

    for r in sorted(rows.mapInPandas(folded, "o long, n long, c binary").collect()):
        state = (state * pow(PRIME, r["n"], 1 << 64) + int.from_bytes(r["c"], "little")) & _MASK
    return f"{state:016X}", n_rows


def _bytes(b: pd.DataFrame, width: int) -> np.ndarray:
    words = np.empty((len(b), 1 + 2 * width), np.int64)
    words[:, 0] = b["o"]
    for i in range(width):
        words[:, 1 + 2 * i], words[:, 2 + 2 * i] = i, b[f"v{i}"]
    return np.ascontiguousarray(words.astype("<i8")).view(np.uint8).ravel()


def _chunks(stream: np.ndarray, size: int = 1 << 18):
    for i in range(0, len(stream), size):
        yield stream[i : i + size]


def _fold(state: int, stream: np.ndarray) -> int:
    for x in stream.tolist():
        state = ((state ^ x) * PRIME) & _MASK
    return state


def _bit(stream: np.ndarray, seen: np.ndarray, k: int) -> np.ndarray:
    """Bit k of the low byte before each byte of the stream and after the last, from a start of 0.

    Bit k of the next low byte is a xor of bit k of (low xor byte) with what
    the lower bits carry in, so with those known it is a running xor; from a
    start of 1 it is the opposite throughout.
    """
    known = (seen[:-1] ^ stream) & ((1 << k) - 1)
    carry = (known.astype(np.uint16) * (PRIME & 255) >> k).astype(np.uint8) & 1
    turn = carry ^ (stream >> k & 1)  # the multiplier is odd: bit k itself passes on
    return np.bitwise_xor.accumulate(np.concatenate([np.zeros(1, np.uint8), turn]))


def _trace(stream: np.ndarray, low: int) -> np.ndarray:
    """The low byte before each byte of the stream, and after the last, bit by bit from the lowest."""
    seen = np.zeros(len(stream) + 1, np.uint8)
    for k in range(8):
        seen |= (_bit(stream, seen, k) ^ np.uint8(low >> k & 1)) << k
    return seen


def _low_map(stream: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Compose with the map of low byte in to low byte out.

    Starts that agree in their lower bits share the traces of those, so the 256
    of them take 255 running xors, depth first.
    """
    ends = np.empty(256, np.uint8)

    def fill(seen: np.ndarray, k: int, low: int) -> None:
        bit = _bit(stream, seen, k)
        for one in (0, 1):
            start = low | one << k
            if k == 7:
                ends[start] = seen[-1] | (bit[-1] ^ one) << 7
            else:
                fill(seen | (bit ^ np.uint8(one)) << k, k + 1, start)

    fill(np.zeros(len(stream) + 1, np.uint8), 0, 0)
    return ends[maps]


def _affine(stream: np.ndarray, low: int) -> tuple[int, int]:
    """(C, low byte out) of the stream for the low byte coming in."""
    seen = _trace(stream, low)
    gain = (seen[:-1] ^ stream).astype(np.int64) - seen[:-1].astype(np.int64)
    powers = np.empty(len(stream), np.uint64)
    powers[:] = PRIME
    powers = np.multiply.accumulate(powers)[::-1]  # P^n ... P^1
    return int((gain.astype(np.uint64) * powers).sum(dtype=np.uint64)), int(seen[-1])
