"""Numpy kernels used inside tasks: small dense solves and the recursion step.

Each works on stacks of series at once.  Spark decides which series share a task.
"""

import numpy as np

from dayloom.schema import HARMONICS, LAGS, WINDOWS


def calendar_block(t, day_number, periods, harmonics=HARMONICS):
    """Columns trend, dow_0..6 and Fourier terms for days ``t`` after the first."""
    weekday = (day_number + 3) % 7  # 1970-01-01 was a Thursday
    angles = [2.0 * np.pi * k * t / p for p in periods for k in range(1, harmonics + 1)]
    waves = [f(a) for a in angles for f in (np.sin, np.cos)]
    return np.column_stack([t, *(weekday == i for i in range(7)), *waves]).astype(float)


def walk(histories, horizon, predict, lags=LAGS, windows=WINDOWS):
    """Advance many series day by day, each prediction entering its own history.

    ``histories`` holds the newest values of each series; ``predict(step, recent)``
    gets the lag and average columns of all series and returns one value per series.
    A lag further back than the history takes the last value.  A day is one row of memory,
    and a window is summed from the sums of the next smaller one, so no sum runs on and drifts.
    """
    memory = max([*lags, *windows])
    count = np.array([min(len(h), memory) for h in histories])
    least, most = count.min(initial=memory), count.max(initial=0)
    values = np.zeros((memory + horizon, len(histories)))
    for column, h in enumerate(histories):
        if count[column]:
            values[memory - count[column]:memory, column] = h[-count[column]:]
    recent = np.empty((len(lags) + len(windows), len(histories)))
    order = sorted(range(len(windows)), key=windows.__getitem__)
    # sums[k][t] is the sum of the k-th smallest window before day t
    sums = [np.empty((memory + horizon, len(histories))) for _ in order[:-1]]

    def total(k, end):
        w = windows[order[k]]
        if not k:
            return values[end - w:end].sum(axis=0)
        below = windows[order[k - 1]]
        whole, rest = divmod(w, below)
        out = sums[k - 1][end - (whole - 1) * below:end + 1:below].sum(axis=0)
        return out + values[end - w:end - w + rest].sum(axis=0) if rest else out

    with np.errstate(all="ignore"):
        for k in range(len(sums)):
            for end in range(memory - windows[order[-1]] + windows[order[k]], memory):
                sums[k][end] = total(k, end)
        for step in range(horizon):
            end = memory + step
            last = values[end - 1]
            for i, n in enumerate(lags):
                if least + step >= n:
                    recent[i] = values[end - n]
                elif most + step < n:
                    recent[i] = last
                else:
                    recent[i] = np.where(count + step >= n, values[end - n], last)
            for k, i in enumerate(order):
                w, of = windows[i], total(k, end)
                if k < len(sums):
                    sums[k][end] = of
                size = w if least + step >= w else np.maximum(np.minimum(count + step, w), 1)
                np.divide(of, size, out=recent[len(lags) + i])
            values[end] = predict(step, recent.T)
    return values[memory:].T


def ridge(gram, cross, alpha):
    """Solve (G + alpha I) w = c for stacks: gram (S,d,d), cross (S,d,T)."""
    d = gram.shape[-1]
    eye = np.eye(d)
    return np.linalg.solve(gram + np.reshape(alpha, (-1, 1, 1)) * eye, cross)


def _support(on, none):
    """Columns of each problem's own support, filled up to the widest with the column ``none``."""
    size = on.sum(axis=1)
    row, column = np.nonzero(on)
    at = np.full((len(on), max(int(size.max()), 1)), none)
    at[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column
    return at


def elastic_net(gram, cross, l1, l2, rounds=None, of=None):
    """Minimise w'Gw/2 - c'w + l1 |w| + l2 |w|^2 / 2 for stacks (S,d,d) and (S,d).

    Active-set descent, all problems in step: take in the coordinate that violates
    optimality most, solve on the support, stop at the first weight to reach zero and
    let it go.  The objective falls at each move, so every problem ends at its optimum; one
    that rounding keeps from settling within ``rounds`` moves (by default far more than any
    needs) comes back as NaN, as a failed fit.  Only the support's rows of a matrix are read, and
    with ``of``, the place of each problem's matrix, several problems may share one.
    """
    s, d = cross.shape
    # a last column of zeros fills up supports that are smaller than others
    wider, c = np.zeros((len(gram), d + 1, d + 1)), np.zeros((s, d + 1))
    wider[:, :d, :d], c[:, :d] = gram, cross
    entries = wider.reshape(-1)
    result, todo = np.zeros((s, d)), np.arange(s)
    w, sign = np.zeros((s, d + 1)), np.zeros((s, d + 1))
    banned = np.zeros((s, d + 1), dtype=bool)   # entries that cannot move off zero for now
    settled = np.ones(s, dtype=bool)
    floor = 1e-12 * np.abs(cross).max(axis=1)
    of = np.arange(s) if of is None else of
    jitter = 1e-13 * np.einsum("sjj->sj", gram).max(axis=1)
    slope = c
    for _ in range(rounds or 1000 + 50 * d):
        if not len(todo):
            return result
        excess = np.where((sign != 0) | banned, -np.inf, np.abs(slope))
        entrant = excess[:, :d].argmax(axis=1)
        rows = np.arange(len(todo))
        open_ = excess[rows, entrant] > l1 * (1 + 1e-10) + floor
        done = settled & ~open_
        if done.any():
            result[todo[done]] = w[done, :d]
            keep = ~done
            todo, of, c, w, sign = todo[keep], of[keep], c[keep], w[keep], sign[keep]
            banned, settled, floor = banned[keep], settled[keep], floor[keep]
            slope, entrant, rows = slope[keep], entrant[keep], np.arange(keep.sum())
            if not len(todo):
                break
        entering = rows[settled]
        sign[entering, entrant[settled]] = np.sign(slope[entering, entrant[settled]])
        at = _support(sign != 0, d)
        own = rows[:, None], at
        lines = of[:, None] * (d + 1) + at
        lhs = entries.take(lines[:, :, None] * (d + 1) + at[:, None, :])
        diagonal = np.arange(at.shape[1])
        lhs[:, diagonal, diagonal] += np.where(at < d, l2 + jitter[of][:, None], 1.0)
        signed, was = sign[own], w[own]
        exact = np.linalg.solve(lhs, (c[own] - l1 * signed)[:, :, None])[:, :, 0]
        leaving = (signed != 0) & (exact * signed <= 0)
        gap = was - exact
        step = np.where(leaving, was / np.where(gap == 0, 1.0, gap), np.inf)
        first = step.argmin(axis=1)
        length = np.minimum(step[rows, first], 1.0)
        blocked = step[rows, first] < 1.0
        stuck = blocked & (length <= 0)
        now = was + length[:, None] * (exact - was)
        now[rows[blocked], first[blocked]] = 0.0
        leaver = at[rows, first]
        w[own] = now
        sign[rows[blocked], leaver[blocked]] = 0.0
        banned[~stuck] = False
        banned[rows[stuck], leaver[stuck]] = True
        settled = ~blocked | stuck
        slope = c - np.matmul(now[:, None, :], wider.reshape(-1, d + 1).take(lines, axis=0))[:, 0] - l2 * w
    result[todo] = np.nan
    return result


def _note(log, done):
    """Rounds taken go into a caller's list; negative ones ran out."""
    if log is not None:
        log.append(done)


def bayesian_ridge(gram, cross, yy, n, prior=1e-6, tol=1e-3, rounds=300, log=None):
    """Evidence maximisation for one target: noise and weight precision re-estimated in
    turn from the eigenvalues of the centred Gram matrix (MacKay's update).

    The limit of rounds is part of the model; a fit that reaches it is given, and noted in ``log``."""
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    rotated = vectors.T @ cross
    noise, weight = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    previous = None
    for done in range(1, rounds + 1):
        w = vectors @ (rotated / (values + weight / noise))
        if previous is not None and np.abs(w - previous).sum() < tol:
            _note(log, done)
            break
        previous = w
        effective = float((noise * values / (weight + noise * values)).sum())
        error = max(float(yy - 2 * w @ cross + w @ gram @ w), 0.0)
        weight = (effective + 2 * prior) / (float(w @ w) + 2 * prior)
        noise = (n - effective + 2 * prior) / (error + 2 * prior)
    else:
        _note(log, -rounds)
    return vectors @ (rotated / (values + weight / noise))


def huber(x, y, epsilon=1.35, alpha=1e-4, rounds=5000, tol=1e-10, loose=1e-6, log=None):
    """Joint scale-and-weights Huber fit: reweighted ridge, then the scale that zeroes
    its own derivative.  Returns (weights, intercept), NaN if the rounds run out.  Rows at the edge
    of the loss may keep the last digits moving, so ``loose`` is enough after 300 rounds; rows that
    the columns fit exactly end once the scale is a billionth of the target's."""
    n, d = x.shape
    design = np.column_stack([x, np.ones(n)])
    penalty = np.diag(np.append(np.full(d, 2.0 * alpha), 0.0))
    beta = np.append(np.zeros(d), np.median(y))
    scale = max(float(np.std(y)), 1e-12)
    exact = 1e-9 * scale
    for done in range(1, rounds + 1):
        r = y - design @ beta
        size = np.abs(r)
        inside = size <= epsilon * scale
        weight = np.where(inside, 1.0, epsilon * scale / np.maximum(size, 1e-300))
        lhs = 2.0 * design.T @ (design * weight[:, None]) / scale + penalty
        new = np.linalg.solve(lhs + 1e-12 * np.eye(d + 1), 2.0 * design.T @ (weight * y) / scale)
        r = y - design @ new
        inside = np.abs(r) <= epsilon * scale
        free = n - epsilon ** 2 * (~inside).sum()
        moved = np.sqrt((r[inside] ** 2).sum() / free) if free > 0 and inside.any() else scale
        moved = max(float(moved), 1e-12)
        change = np.abs(new - beta).max() / max(np.abs(new).max(), 1e-12)
        change = max(change, abs(moved - scale) / moved)
        beta, scale = new, moved
        if change < tol or scale <= exact or done >= 300 and change < loose:
            _note(log, done)
            return beta[:d], beta[d]
    _note(log, -rounds)
    return np.full(d, np.nan), np.nan


def insensitive(x, y, c=1.0, epsilon=0.1, penalise_intercept=False, rounds=20000, tol=1e-8, log=None):
    """Linear regression under the epsilon-insensitive loss, |w|^2/2 + C sum(loss), by
    splitting residuals from weights (ADMM).  Returns (weights, intercept), NaN if the rounds run out."""
    n, d = x.shape
    design = np.column_stack([x, np.ones(n)])
    base = np.eye(d + 1)
    base[d, d] = 1.0 if penalise_intercept else 1e-10
    spread = max(float(np.median(np.abs(y - np.median(y)))), 1e-9)
    rho = c / spread
    gram = design.T @ design
    solve = np.linalg.inv(base + rho * gram)
    z, u = y - np.median(y), np.zeros(n)
    beta = np.zeros(d + 1)
    for step in range(rounds):
        beta = solve @ (rho * (design.T @ (y - z - u)))
        r = y - design @ beta
        old = z
        v = r - u
        size = np.abs(v)
        shrunk = np.where(size <= epsilon, size,
                          np.where(size <= epsilon + c / rho, epsilon, size - c / rho))
        z = np.sign(v) * shrunk
        u = u + z - r
        primal, dual = np.linalg.norm(z - r), rho * np.linalg.norm(design.T @ (z - old))
        if primal <= tol * max(np.linalg.norm(z), 1.0) and dual <= tol * max(n * c, 1.0):
            _note(log, step + 1)
            return beta[:d], beta[d]
        if step % 50 == 49:
            ratio = (primal / max(np.linalg.norm(z), 1e-12)) / max(dual / (n * c), 1e-300)
            if ratio > 10 or ratio < 0.1:
                factor = 2.0 if ratio > 10 else 0.5
                rho, u = rho * factor, u / factor
                solve = np.linalg.inv(base + rho * gram)
    _note(log, -rounds)
    return np.full(d, np.nan), np.nan


def nearest_mean(train_x, train_y, x, k=5, more=0.0):
    """Mean target of the k nearest rows (Euclidean); ties go to the earlier row.

    ``more`` is what other columns add to the squared distances."""
    distance = ((train_x - x) ** 2).sum(axis=1) + more
    k = min(k, len(train_y))
    if k < len(distance):
        limit = np.partition(distance, k - 1)[k - 1]
        close = np.flatnonzero(distance <= limit)
        close = close[np.argsort(distance[close], kind="stable")][:k]
    else:
        close = np.arange(len(distance))
    return float(train_y[close].mean())
