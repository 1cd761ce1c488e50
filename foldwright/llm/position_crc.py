"""CRC-32 of many byte spans at once, by position tables.

Apart from a constant for its length, the CRC of a span is the exclusive or of one value for each byte that
depends on the byte and on its distance from the span's end alone.  These values are looked up for all bytes
of all spans and folded with ``bitwise_xor.reduceat``.  A span longer than the table is cut into blocks from its
end; each block is folded as a short span, moved by its distance and folded again.
"""

import zlib

import numpy as np

#: Distances in the table, and bytes looked up at once.
REACH, AT_ONCE = 64, 1 << 18


def _append_zero(register: np.ndarray) -> np.ndarray:
    return (register >> np.uint32(8)) ^ TABLE[0][register & np.uint32(255)]


#: ``TABLE[d][b]``: what byte ``b`` adds with ``d`` bytes behind it.
TABLE = np.zeros((REACH, 256), np.uint32)
TABLE[0] = [zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)]
for _d in range(1, REACH):
    TABLE[_d] = _append_zero(TABLE[_d - 1])
_FLAT = TABLE.ravel()
#: CRC of so many zero bytes.
ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)


def _shifts(powers: int = 40) -> np.ndarray:
    """``[k][i][b]``: byte ``i`` of a register of value ``b``, moved by 2^k zero bytes."""
    out = np.zeros((powers, 4, 256), np.uint32)
    for i in range(4):
        out[0, i] = _append_zero(np.arange(256, dtype=np.uint32) << np.uint32(8 * i))
    for k in range(1, powers):
        out[k] = _through(out[k - 1], out[k - 1])
    return out


def _through(step: np.ndarray, register: np.ndarray) -> np.ndarray:
    out = step[0][register & np.uint32(255)]
    for i in (1, 2, 3):
        out = out ^ step[i][(register >> np.uint32(8 * i)) & np.uint32(255)]
    return out


_SHIFTS = _shifts()


def shifted(register: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers moved by so many zero bytes each, one power of two at a time."""
    for k in range(int(by.max()).bit_length() if len(by) else 0):
        register = np.where((by >> k) & 1, _through(_SHIFTS[k], register), register)
    return register


def _folded(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Exclusive or of the position values of spans of 1 to ``REACH`` bytes."""
    out = np.empty(len(start), np.uint32)
    stop = np.cumsum(size)
    a = 0
    while a < len(start):
        done = stop[a] - size[a]
        b = max(a + 1, int(np.searchsorted(stop, done + AT_ONCE, "right")))
        n = size[a:b].astype(np.int32)
        first = (stop[a:b] - size[a:b] - done).astype(np.int32)
        place = np.arange(stop[b - 1] - done, dtype=np.int32)
        spot = place + np.repeat(start[a:b].astype(np.int32) - first, n)
        behind = np.repeat(first + n - 1, n) - place
        out[a:b] = np.bitwise_xor.reduceat(_FLAT[(behind << 8) + buf[spot]], first)
        a = b
    return out


def crc32(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each span ``buf[start:end]`` (at least one byte; spans may overlap; ``buf`` below 2 GB)."""
    size = end - start
    out = np.zeros(len(start), np.uint32)
    long = size > REACH
    short = np.flatnonzero(~long)
    out[short] = _folded(buf, start[short], size[short]) ^ ZEROS[size[short]]
    for s in np.flatnonzero(long):  # rare: a span of more than REACH bytes
        n = int(size[s])
        blocks = -(-n // REACH)
        behind = np.arange(blocks - 1, -1, -1) * REACH  # bytes behind each block
        low = np.maximum(int(start[s]), int(end[s]) - behind - REACH)
        value = shifted(_folded(buf, low, int(end[s]) - behind - low), behind)
        ones = shifted(np.array([0xFFFFFFFF], np.uint32), np.array([n]))[0] ^ np.uint32(0xFFFFFFFF)
        out[s] = np.bitwise_xor.reduce(value) ^ ones
    return out
