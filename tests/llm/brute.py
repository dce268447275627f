"""Plain versions of what the operators compute with Spark, for the tests."""

import struct

import xxhash


def spark_hash(*values, seed=42):
    """Spark's xxhash64 of strings, integers (32 bits, as ``("int", n)``) and longs; nulls are passed over. Signed."""
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def targets(sizes, repeats=3):
    """Target words by source: full sources stop, the rest is shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        free = [s for s in order if s not in full]
        if not free:
            return {s: float(repeats * sizes[s]) for s in order}
        unit = (sum(sizes.values()) - sum(repeats * sizes[s] for s in full)) / sum(weight[s] for s in free)
        more = {s for s in free if repeats * sizes[s] < unit * weight[s]}
        if not more:
            return {s: float(repeats * sizes[s]) if s in full else unit * weight[s] for s in order}
        full |= more


def trade(c, x, u):
    """Two (item, at, p, w): what is decided (item, copies), and what stays open."""
    up, down = min((1 - c[2]) * c[3], x[2] * x[3]), min(c[2] * c[3], (1 - x[2]) * x[3])
    if u * (up + down) < down:  # words move to c
        if (1 - c[2]) * c[3] <= x[2] * x[3]:
            return (c[0], 1), (x[0], x[1], max(x[2] - up / x[3], 0.0), x[3])
        return (x[0], 0), (c[0], c[1], min(c[2] + up / c[3], 1.0), c[3])
    if c[2] * c[3] <= (1 - x[2]) * x[3]:
        return (c[0], 0), (x[0], x[1], min(x[2] + down / x[3], 1.0), x[3])
    return (x[0], 1), (c[0], c[1], max(c[2] - down / c[3], 0.0), c[3])


def deal(items, chunk, seed):
    """Pivotal rounding of [(item, at, p, w)]: {item: 0 or 1}, trade by trade, chunk by chunk, level by level."""
    out = {}
    while items:
        groups = {}
        for item in sorted(items, key=lambda i: i[1]):
            groups.setdefault(item[1] // chunk, []).append(item)
        items = []
        for k, (c, *rest) in groups.items():
            for x in rest:
                u = (spark_hash(("int", seed), c[1], x[1]) & ((1 << 52) - 1)) / float(1 << 52)
                done, c = trade(c, x, u)
                out[done[0]] = done[1]
            items.append((c[0], k, c[2], c[3]))
        if len(items) == 1 and items[0][1] == 0:
            item, _, p, _ = items[0]
            out[item] = int(p >= 0.5)
            return out
    return out


def edits(pattern, text):
    """Least edits of ``pattern`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)
