"""Short sequential versions that the Spark operators are compared with."""

import numpy as np


def squared_gaps(x):
    gaps = np.zeros((len(x), len(x)))
    for i in range(x.shape[1]):
        d = x[:, i][:, None] - x[:, i][None, :]
        gaps = gaps + d * d
    return gaps


def density(x, eps, min_samples, weights=None):
    """(dbscan labels, optics labels, core flags) by scanning the rows in order."""
    n = len(x)
    weights = np.ones(n) if weights is None else np.asarray(weights)
    near = squared_gaps(x) <= eps * eps
    core = (near * weights).sum(axis=1) >= min_samples
    labels = np.full(n, -1)
    starts = []
    for i in range(n):
        if not core[i] or labels[i] != -1:
            continue
        cluster = len(starts)
        starts.append(i)
        labels[i] = cluster
        stack = [i]
        while stack:
            row = stack.pop()
            for j in np.flatnonzero(near[row] & (labels == -1)):
                labels[j] = cluster
                if core[j]:
                    stack.append(j)
    ordered = labels.copy()
    for i in range(n):
        if labels[i] >= 0 and not core[i] and starts[labels[i]] >= i:
            ordered[i] = -1
    return labels, ordered, core


def walk(x, rtol):
    """(representatives, counts) of the sequential combining."""
    order = np.lexsort(np.fliplr(x).T)
    reps, counts, last = [], [], None
    for i in order:
        row = x[i]
        if last is None or np.sqrt(((row - last) ** 2).sum()) > tolerance:
            reps.append(row)
            counts.append(1)
            last = row
            tolerance = rtol * (np.sqrt((row * row).sum()) + rtol)
        else:
            counts[-1] += 1
    return np.array(reps), counts


def fnv1_64(data, init=0):
    value = init
    for byte in data:
        value = (value * 1099511628211) % 2**64 ^ byte
    return value
