"""Plain loops that state what each order-dependent operator means."""

import numpy as np


def nelson(values, cl, sigma, ucl, lcl, test, n=None, window=None):
    x = list(values)
    flags = [False] * len(x)
    n = n or {2: 9, 3: 6, 4: 14, 5: 2, 6: 4, 7: 15, 8: 8}.get(test)
    window = window or {5: 3, 6: 5}.get(test)
    for i in range(len(x)):
        last = x[max(0, i - (n or 1) + 1): i + 1]
        if test == 1:
            flags[i] = x[i] > ucl or x[i] < lcl
        elif test == 2:
            flags[i] = len(last) == n and (all(v > cl for v in last) or all(v < cl for v in last))
        elif test == 3:
            d = np.diff(last)
            flags[i] = len(last) == n and (all(d > 0) or all(d < 0))
        elif test == 4:
            d = np.sign(np.diff(last))
            flags[i] = (
                len(last) == n and all(d != 0) and all(a == -b for a, b in zip(d, d[1:]))
            )
        elif test in (5, 6):
            k = 2 if test == 5 else 1
            zone = [1 if v >= cl + k * sigma else -1 if v <= cl - k * sigma else 0
                    for v in x[max(0, i - window + 1): i + 1]]
            flags[i] = len(zone) == window and zone[-1] != 0 and zone.count(zone[-1]) >= n
        elif test == 7:
            flags[i] = len(last) == n and all(cl - sigma < v < cl + sigma for v in last)
        elif test == 8:
            flags[i] = len(last) == n and not any(cl - sigma < v < cl + sigma for v in last)
    return flags


def westgard(values, cl, sigma, rule):
    x = list(values)

    def far(v, k):
        return 1 if v > cl + k * sigma else -1 if v < cl - k * sigma else 0

    def run(i, n, k):
        if i < n - 1:
            return False
        sides = {far(v, k) for v in x[i - n + 1: i + 1]}
        return sides in ({1}, {-1})

    tests = {
        "1_2s": lambda i: far(x[i], 2) != 0,
        "1_3s": lambda i: far(x[i], 3) != 0,
        "2_2s": lambda i: run(i, 2, 2),
        "r_4s": lambda i: i > 0 and abs(x[i] - x[i - 1]) > 4 * sigma,
        "4_1s": lambda i: run(i, 4, 1),
        "10_x": lambda i: run(i, 10, 0),
    }
    return [tests[rule](i) for i in range(len(x))]


def ewma(values, target, lam):
    out, level = [], target
    for v in values:
        level = lam * v + (1 - lam) * level
        out.append(level)
    return out


def cusum(values, target, sigma, k, head=0.0):
    up, down, ups, downs = head, -head, [], []
    for v in values:
        z = (v - target) / sigma
        up, down = max(0.0, up + z - k), min(0.0, down + z + k)
        ups.append(up)
        downs.append(down)
    return ups, downs


def shift_starts(stat, signals):
    starts, inside = [], False
    for i, s in enumerate(signals):
        if s and not inside:
            zeros = [j for j in range(i) if stat[j] == 0]
            starts.append((i, zeros[-1] + 1 if zeros else 0))
        inside = s
    return starts


def count_runs(values, center):
    sides = [1 if v > center else -1 for v in values if v != center]
    return sum(i == 0 or a != sides[i - 1] for i, a in enumerate(sides))
