"""Plain double-loop statement of the rating update, for comparison only."""

import math


def rate_race(teams, ranks, beta=25 / 120, kappa=1e-4, tau=0.0, weights=None):
    """teams: list of lists of (mu, sigma). Weng and Lin 2011, algorithm 4."""
    widened = [[(m, math.sqrt(s * s + tau * tau)) for m, s in t] for t in teams]
    mus = [sum(m for m, _ in t) for t in widened]
    variances = [sum(s * s for _, s in t) for t in widened]
    c = math.sqrt(sum(v + beta**2 for v in variances))
    out = []
    for i, team in enumerate(widened):
        e_i = math.exp(mus[i] / c)
        omega = delta = 0.0
        for q in range(len(teams)):
            if ranks[q] > ranks[i]:
                continue
            s_q = sum(math.exp(mus[s] / c) for s in range(len(teams)) if ranks[s] >= ranks[q])
            a_q = sum(1 for s in range(len(teams)) if ranks[s] == ranks[q])
            p = e_i / s_q
            omega += ((1 - p) if q == i else -p) / a_q
            delta += p * (1 - p) / a_q
        omega *= variances[i] / c
        delta *= math.sqrt(variances[i]) / c * variances[i] / c**2
        new = []
        for j, (m, s) in enumerate(team):
            w = weights[i][j] if weights else 1.0
            gain = w if omega >= 0 else 1 / w
            share = s * s / variances[i]
            new.append((m + share * omega * gain,
                        s * math.sqrt(max(1 - share * delta * gain, kappa))))
        out.append(new)
    return out


def phi(x):
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def predicted_places(teams, beta=25 / 120):
    n = len(teams)
    mus = [sum(m for m, _ in t) for t in teams]
    variances = [sum(s * s for _, s in t) for t in teams]
    chance = [
        round(sum(phi((mus[a] - mus[b]) / math.sqrt(n * beta**2 + variances[a] + variances[b]))
                  for b in range(n) if b != a), 11)
        for a in range(n)
    ]
    return [1 + sum(1 for x in chance if x > chance[i]) for i in range(n)]


def fold(rows, mu=25.0, sigma=25 / 3, tau=25 / 300):
    """rows: (pool, seq, team, rank, key) -> {(pool, seq, key): (before, after, place)}."""
    state, out = {}, {}
    for pool, seq in sorted({(r[0], r[1]) for r in rows}):
        race = [r for r in rows if r[0] == pool and r[1] == seq]
        names = sorted({r[2] for r in race})
        members = [[r for r in race if r[2] == t] for t in names]
        before = [[state.get((pool, r[4]), (mu, sigma)) for r in m] for m in members]
        ranks = [m[0][3] for m in members]
        places = predicted_places(before)
        after = rate_race(before, ranks, tau=tau)
        for m, b, a, place in zip(members, before, after, places):
            for r, x, y in zip(m, b, a):
                state[(pool, r[4])] = y
                out[(pool, seq, r[4])] = (x, y, place)
    return out
