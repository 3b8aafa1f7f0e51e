"""Exact linear fits of one series with any number of category columns.

A category column is 0 or 1, so a series is held as a few dense columns and the list of its ones: a
row has as many as its labels, however many columns there are.  Every normal equation is solved
by eliminating the category columns first.  Their block is a diagonal when no day has two of the
columns in use, and otherwise as sparse as the days are, so conjugate gradients solve it; what is
left is a small dense system.  No matrix over columns is ever formed.

Coordinates inside: dense columns standardised, category columns as they are, an intercept of its
own (so nothing needs centring).
"""

import numpy as np

TOLERANCE = 1e-12


class Hits:
    """A 0/1 matrix given by its ones, as products with dense blocks."""

    def __init__(self, rows, cols, n, width):
        order = np.lexsort((cols, rows))
        self.rows, self.cols, self.n, self.width = rows[order], cols[order], n, width
        self.count = np.bincount(self.cols, minlength=width).astype(float)
        self._by_col = np.argsort(self.cols, kind="stable")
        self._col_rows = self.rows[self._by_col]
        self._cols, self._col_starts = np.unique(self.cols[self._by_col], return_index=True)
        self._rows, self._row_starts = np.unique(self.rows, return_index=True)
        #: no row has two ones: the normal equations are a diagonal
        self.single = len(self._rows) == len(self.rows)

    def times(self, v):
        out = np.zeros((self.n, *v.shape[1:]))
        if len(self.rows):
            out[self._rows] = np.add.reduceat(v[self.cols], self._row_starts, axis=0)
        return out

    def transposed(self, y):
        out = np.zeros((self.width, *y.shape[1:]))
        if len(self.rows):
            out[self._cols] = np.add.reduceat(y[self._col_rows], self._col_starts, axis=0)
        return out

    def subset(self, chosen):
        """The matrix of the columns in the mask ``chosen``."""
        new = np.cumsum(chosen) - 1
        keep = chosen[self.cols]
        return Hits(self.rows[keep], new[self.cols[keep]], self.n, int(chosen.sum()))

    def solve(self, weight, penalty, rhs, start=None, rounds=2000):
        """(Z' diag(weight) Z + diag(penalty)) x = rhs for several right sides, from a guess ``start``."""
        diagonal = (self.count if weight is None else self.transposed(weight)) + penalty
        diagonal = np.where(diagonal > 0, diagonal, 1.0)[:, None]
        x = rhs / diagonal
        if self.single or not len(x):
            return x

        def product(v):
            inner = self.times(v)
            return self.transposed(inner if weight is None else inner * weight[:, None]) + penalty[:, None] * v

        x = x if start is None else start
        r = rhs - product(x)
        goal = TOLERANCE * np.maximum(np.sqrt((rhs ** 2).sum(axis=0)), 1e-300)
        z = r / diagonal
        p, rz = z, (r * z).sum(axis=0)
        for _ in range(rounds):
            if (np.sqrt((r ** 2).sum(axis=0)) <= goal).all():
                break
            q = product(p)
            pq = (p * q).sum(axis=0)
            a = np.where(pq > 0, rz / np.where(pq > 0, pq, 1.0), 0.0)
            x, r = x + a * p, r - a * q
            z = r / diagonal
            new = (r * z).sum(axis=0)
            p, rz = z + np.where(rz > 0, new / np.where(rz > 0, rz, 1.0), 0.0) * p, new
        return x


class Design:
    """Dense columns ``x`` and ones at (rows, cols) of ``width`` category columns."""

    def __init__(self, x, rows, cols, width):
        n = len(x)
        self.n, self.centre, spread = n, x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(spread <= 1e-14 * np.maximum(np.abs(self.centre), 1.0), 1.0, spread)
        self.x = (x - self.centre) / self.scale
        self.base = np.column_stack([np.ones(n), self.x])
        count = np.bincount(cols, minlength=width)
        #: a column that is the same on every row can't be told from the intercept; it gets no weight
        self.live = (count > 0) & (count < n)
        self.hits = Hits(rows, cols, n, width).subset(self.live)
        self.mean = self.hits.count / n
        self.spread = np.sqrt(self.mean * (1 - self.mean))
        self.cross = self.hits.transposed(self.base)

    def solver(self, dense_penalty, level_penalty, weight=None, on=None, jitter=0.0, near=None):
        """A function of (target, linear terms) that minimises the penalised squares.

        ``on`` restricts the columns (dense mask, level mask).  Returns intercept, dense and level
        coefficients with zeros off the restriction.  ``near`` is the solver of a similar problem:
        iterations start from its results.
        """
        dense_on = np.ones(self.x.shape[1], bool) if on is None else on[0]
        level_on = None if on is None or on[1].all() else on[1]
        hits = self.hits if level_on is None else self.hits.subset(level_on)
        penalty = level_penalty if level_on is None else level_penalty[level_on]
        keep = np.r_[True, dense_on]
        base = self.base[:, keep]
        weighted = base if weight is None else base * weight[:, None]
        cross = hits.transposed(weighted) if weight is not None else (self.cross if level_on is None else self.cross[level_on])[:, keep]
        penalty = penalty + jitter * max(float(hits.count.max(initial=0.0)), 1.0)
        levels = slice(None) if level_on is None else level_on
        guess = near.guess if near is not None else {}
        reduced = hits.solve(weight, penalty, cross, guess["side"][levels][:, keep] if guess else None)
        small = base.T @ weighted + np.diag(np.r_[0.0, dense_penalty[dense_on] + jitter * self.n]) - cross.T @ reduced
        inverse = np.linalg.inv(small)

        def solve(target, dense_linear=None, level_linear=None):
            t = target if weight is None else target * weight
            top, side = base.T @ t, hits.transposed(t)
            if dense_linear is not None:
                top = top + np.r_[0.0, dense_linear[dense_on]]
                side = side + (level_linear if level_on is None else level_linear[level_on])
            own = hits.solve(weight, penalty, side[:, None], guess["own"][levels][:, None] if "own" in guess else None)[:, 0]
            rest = top - cross.T @ own
            beta = inverse @ rest
            beta = beta + inverse @ (rest - small @ beta)
            dense, level = np.zeros(self.x.shape[1]), np.zeros(self.hits.width)
            dense[dense_on] = beta[1:]
            level[levels] = own - reduced @ beta
            if not hits.single:
                guess["own"] = np.zeros(self.hits.width)
                guess["own"][levels] = own
            return beta[0], dense, level

        if not hits.single:
            guess = {**guess, "side": np.zeros(self.cross.shape)}
            guess["side"][np.ix_(np.arange(self.hits.width)[levels], keep)] = reduced
        solve.inverse, solve.reduced, solve.guess = inverse, reduced, guess
        return solve

    def values(self, dense, level):
        """The columns' part of the prediction, without the intercept."""
        return self.x @ dense + self.hits.times(level)

    def weights(self, intercept, dense, level):
        """Weights on the columns as given, then the intercept."""
        raw, every = dense / self.scale, np.zeros(len(self.live))
        every[self.live] = level
        return np.concatenate([raw, every, [intercept - raw @ self.centre]])

    def failed(self):
        return np.full(self.x.shape[1] + len(self.live) + 1, np.nan)


def ridge(design, y, alpha):
    """Squares plus alpha |w|^2 in the units of the columns."""
    solve = design.solver(alpha / design.scale ** 2, np.full(design.hits.width, float(alpha)))
    return design.weights(*solve(y)), 1


def scaled_ridge(design, y, alpha):
    """Mean squares plus alpha |w|^2 on standardised columns."""
    p = design.x.shape[1]
    solve = design.solver(np.full(p, alpha * design.n), alpha * design.n * design.spread ** 2)
    return design.weights(*solve(y)), 1


def elastic_net(design, y, l1, l2, rounds=None):
    """Mean squares / 2 + l1 |w| + l2 |w|^2 / 2 on standardised columns.

    Takes in columns that violate optimality, solves on the support, moves there as far as the
    objective falls (its exact minimum on the line), and drops what reaches zero.  Ends where
    every column meets the optimality conditions; otherwise the fit has failed.
    """
    p, n = design.x.shape[1], design.n
    spread = np.r_[np.ones(p), design.spread]
    yc = y - y.mean()
    w, rounds = np.zeros(len(spread)), rounds or 200 + 20 * len(spread)
    settled, banned, solve = True, np.zeros(len(spread), bool), None

    def product(v):
        f = design.values(v[:p], v[p:] / design.spread)
        return f - f.mean()

    def gradient(r):
        return np.r_[design.x.T @ r, design.hits.transposed(r) / design.spread] / n

    floor = 1e-12 * np.abs(gradient(yc)).max(initial=0.0)
    loose = 1e-7 * l1 + 1e3 * floor
    for done in range(1, rounds + 1):
        r = yc - product(w)
        slope = gradient(r) - l2 * w
        excess = np.where((w != 0) | banned, 0.0, np.abs(slope) - l1 * (1 + 1e-10) - floor)
        entrants = excess > 0.5 * excess.max(initial=0.0) if settled else np.zeros(len(w), bool)
        if settled and not entrants.any():
            break
        while True:
            sign = np.where(w != 0, np.sign(w), np.where(entrants, np.sign(slope), 0.0))
            on = sign != 0
            solve = design.solver(np.full(p, n * l2), n * l2 * design.spread ** 2, on=(on[:p], on[p:]), jitter=1e-13, near=solve)
            push = -n * l1 * sign * spread
            _, dense, level = solve(y, push[:p], push[p:])
            exact = np.r_[dense, level * design.spread]
            wrong = entrants & (exact * sign <= 0)
            if not wrong.any() or entrants.sum() == 1:
                break
            entrants = entrants & ~wrong
            if not entrants.any():  # keep the one that violates most: alone it goes its way
                entrants = excess == excess.max()
                entrants &= np.cumsum(entrants) == 1
        step = exact - w
        if (exact[on] * sign[on] > 0).all():
            w, settled, banned = exact, True, np.zeros(len(w), bool)
            continue
        t, zero = _line_minimum(w, step, r, product(step), l1, l2)
        if t <= 0:
            banned |= entrants
            settled = True
            if not entrants.any():
                break
            continue
        w = w + t * step
        w[zero] = 0.0
        settled, banned = False, np.zeros(len(w), bool)
    slope = gradient(yc - product(w)) - l2 * w
    gap = np.where(w != 0, np.abs(slope - l1 * np.sign(w)), np.maximum(np.abs(slope) - l1, 0.0)).max(initial=0.0)
    if not gap <= loose:
        return design.failed(), rounds
    raw = np.r_[w[:p], w[p:] / design.spread]
    return design.weights(y.mean() - design.hits.times(raw[p:]).mean(), raw[:p], raw[p:]), done


def _line_minimum(w, step, r, moved, l1, l2):
    """(t, columns at zero there) of the least objective on w + t step, 0 <= t <= 1."""
    n = len(r)
    curve = moved @ moved / n + l2 * step @ step
    sign = np.where(w != 0, np.sign(w), np.sign(step))
    start = -(r @ moved) / n + l2 * w @ step + l1 * step @ sign
    kinks = np.flatnonzero(w * step < 0)
    at = -w[kinks] / step[kinks]
    order = np.argsort(at)
    kinks, at = kinks[order], at[order]
    jump = 2 * l1 * np.abs(step[kinks])
    before = start + curve * at + np.r_[0.0, np.cumsum(jump)[:-1]]
    rising = np.flatnonzero((before >= 0) | (before + jump >= 0))
    k = rising[0] if len(rising) else len(at)
    if k < len(at) and at[k] <= 1 and before[k] < 0:
        return float(at[k]), kinks[at == at[k]]
    level = start + jump[:k].sum()
    end = -level / curve if curve > 0 else 1.0
    t = float(np.clip(end, 0.0, 1.0))
    return t, kinks[at == t]


def _gram_values(hits):
    """Eigenvalues above zero of Z'Z, from connected groups of columns."""
    label = np.arange(hits.width)
    while True:
        least = np.full(hits.n, hits.width)
        np.minimum.at(least, hits.rows, label[hits.cols])
        new = label.copy()
        np.minimum.at(new, hits.cols, least[hits.rows])
        if np.array_equal(new, label):
            break
        label = new
    size = np.bincount(label, minlength=hits.width)
    out = [hits.count[size[label] == 1]]
    for group in np.flatnonzero(size > 1):
        own = hits.subset(label == group)
        rows = np.unique(own.rows)
        block = np.zeros((len(rows), own.width))
        block[np.searchsorted(rows, own.rows), own.cols] = 1.0
        gram = block @ block.T if len(rows) < own.width else block.T @ block
        out.append(np.maximum(np.linalg.eigvalsh(gram), 0.0))
    return np.concatenate(out)


def bayesian_ridge(design, y, prior=1e-6, tol=1e-3, rounds=300):
    """Evidence maximisation: precisions of noise and weights in turn, in the units of the columns.

    The eigenvalues of connected category columns are taken once; memory for them is the
    square of the days, or of the columns if fewer, of the largest connected group.
    """
    n, p = design.n, design.x.shape[1]
    yy = float(((y - y.mean()) ** 2).sum())
    noise, weight, previous = 1.0 / (yy / n + np.finfo(float).eps), 1.0, None
    values = _gram_values(design.hits)
    unseen = design.hits.width - len(values)

    def fit(ratio, near=None):
        solve = design.solver(ratio / design.scale ** 2, np.full(design.hits.width, ratio), near=near)
        return solve, solve(y)

    solve = None
    for done in range(1, rounds + 1):
        solve, (b, dense, level) = fit(weight / noise, solve)
        w = np.r_[dense / design.scale, level]
        if previous is not None and np.abs(w - previous).sum() < tol:
            break
        previous = w
        ratio = weight / noise
        trace = float((1 / (values + ratio)).sum()) + unseen / ratio
        trace += float((np.diag(solve.inverse)[1:] / design.scale ** 2).sum())
        trace += float((solve.inverse * (solve.reduced.T @ solve.reduced)).sum())
        effective = p + design.hits.width - ratio * trace
        error = float(((y - b - design.values(dense, level)) ** 2).sum())
        weight = (effective + 2 * prior) / (float(w @ w) + 2 * prior)
        noise = (n - effective + 2 * prior) / (error + 2 * prior)
    return design.weights(*fit(weight / noise)[1]), done


def huber(design, y, epsilon=1.35, alpha=1e-4, rounds=5000, tol=1e-10, loose=1e-6):
    """Joint scale-and-weights Huber fit on standardised columns by reweighted squares.

    Rows at the edge of the loss may keep the last digits moving: ``loose`` is enough after 300 rounds.
    Ends as well once the scale has fallen to a billionth of the target's: the columns fit it exactly.
    """
    n, p = design.n, design.x.shape[1]
    beta, f = np.zeros(1 + p + design.hits.width), np.full(n, np.median(y))
    beta[0], scale, solve = np.median(y), max(float(np.std(y)), 1e-12), None
    exact = 1e-9 * scale
    for done in range(1, rounds + 1):
        size = np.abs(y - f)
        weight = np.where(size <= epsilon * scale, 1.0, epsilon * scale / np.maximum(size, 1e-300)) * 2 / scale
        solve = design.solver(np.full(p, 2 * alpha), 2 * alpha * design.spread ** 2, weight, near=solve)
        b, dense, level = solve(y)
        f = b + design.values(dense, level)
        r = y - f
        inside = np.abs(r) <= epsilon * scale
        free = n - epsilon ** 2 * (~inside).sum()
        moved = max(float(np.sqrt((r[inside] ** 2).sum() / free)) if free > 0 and inside.any() else scale, 1e-12)
        new = np.r_[b, dense, level * design.spread]
        change = max(np.abs(new - beta).max() / max(np.abs(new).max(), 1e-12), abs(moved - scale) / moved)
        beta, scale = new, moved
        if change < tol or scale <= exact or done >= 300 and change < loose:
            return design.weights(b, dense, level), done
    return design.failed(), rounds


def insensitive(design, y, c=1.0, epsilon=0.1, penalise_intercept=False, rounds=20000, tol=1e-8):
    """|w|^2 / 2 + C times the epsilon-insensitive loss on standardised columns, by splitting."""
    n, p = design.n, design.x.shape[1]
    own = 1.0 if penalise_intercept else 1e-10
    rho = c / max(float(np.median(np.abs(y - np.median(y)))), 1e-9)

    def prepare(near=None):
        return design.solver(np.full(p, 1 / rho), design.spread ** 2 / rho, near=near)

    solve = prepare()
    z, u = y - np.median(y), np.zeros(n)
    for done in range(rounds):
        target = y - z - u
        _, dense, level = solve(target)
        b = rho * target.sum() / (own + rho * n)
        f = design.values(dense, level)
        r = y - b - (f - f.mean())
        old, v = z, r - u
        size = np.abs(v)
        z = np.sign(v) * np.where(size <= epsilon, size, np.where(size <= epsilon + c / rho, epsilon, size - c / rho))
        u = u + z - r
        d = z - old
        back = np.r_[design.x.T @ d, (design.hits.transposed(d) - design.hits.count * d.mean()) / np.where(design.spread > 0, design.spread, 1.0), d.sum()]
        primal, dual = np.linalg.norm(z - r), rho * np.linalg.norm(back)
        if primal <= tol * max(np.linalg.norm(z), 1.0) and dual <= tol * max(n * c, 1.0):
            return design.weights(b - f.mean(), dense, level), done + 1
        if done % 50 == 49:
            ratio = (primal / max(np.linalg.norm(z), 1e-12)) / max(dual / (n * c), 1e-300)
            if ratio > 10 or ratio < 0.1:
                factor = 2.0 if ratio > 10 else 0.5
                rho, u = rho * factor, u / factor
                solve = prepare(solve)
    return design.failed(), rounds
