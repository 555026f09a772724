"""Plain-Python recursions the closed forms are checked against."""


def croston(y, a=0.1):
    hits = [i for i, v in enumerate(y) if v > 0]
    if not hits:
        return 0.0
    size, gap, prev = y[hits[0]], hits[0] + 1.0, hits[0]
    for i in hits[1:]:
        size += a * (y[i] - size)
        gap += a * ((i - prev) - gap)
        prev = i
    return size / gap


def tsb(y, a=0.1, b=0.1, p=None, start=0):
    hits = [i for i, v in enumerate(y) if v > 0]
    if not hits:
        return 0.0
    f = hits[0]
    size = y[f]
    prob = 1.0 / (f + 1) if p is None else p
    for v in y[start:]:
        prob += b * ((1.0 if v > 0 else 0.0) - prob)
        if v > 0:
            size += a * (v - size)
    return prob * size


def router_tsb(y):
    hits = [i for i, v in enumerate(y) if v > 0]
    return tsb(y, start=hits[0] + 1) if hits else 0.0
