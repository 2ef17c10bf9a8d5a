"""The ordered rating update of one bounded group, in numpy.

A race depends only on the earlier races of its own players. Races are put
in waves (one more than the latest wave of any player); all races of a wave
are updated together, which gives the same result as one race at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from windlass.functions.rating_math import _HART_DEN, _HART_NUM, DEFAULT, RatingParams


# Chances that agree to so many digits are a tie, whatever the race's size.
CHANCE_DIGITS = 9


@dataclass(frozen=True)
class FoldOptions:
    params: RatingParams = field(default_factory=lambda: DEFAULT)
    # 'before' predicts from the ratings before the update, 'after' from those
    # after it, 'none' leaves the column NULL.
    predict: str = "before"
    # Weights are the race's mean rating over the population's mean before it
    # (column `mean`) in place of the column `weight`.
    population: bool = False
    # Spread added for each week but the first since the last race, as a part of
    # the initial one, which it cannot exceed; needs the columns day and last_day.
    weekly: float = 0.0


def _race_numbers(race: np.ndarray) -> np.ndarray:
    """0, 1, ... of each row's race; rows must be grouped by race."""
    return np.cumsum(np.r_[False, race[1:] != race[:-1]])


def races_in_order(rows: pd.DataFrame) -> np.ndarray:
    """A number of each row's race that orders races by seq, then by name. Names are
    sorted only if several races share a seq, and compared once for each race."""
    seq = rows["seq"].to_numpy()
    race, _ = pd.factorize(rows["race"])
    by_seq = np.argsort(seq, kind="stable")
    same = seq[by_seq[1:]] == seq[by_seq[:-1]]
    if (race[by_seq[1:]] != race[by_seq[:-1]])[same].any():
        race, _ = pd.factorize(rows["race"], sort=True)
        by_seq = np.lexsort((race, seq))
    number = np.empty(len(seq), dtype=np.int64)
    number[by_seq] = np.cumsum(np.r_[False, (seq[by_seq[1:]] != seq[by_seq[:-1]])
                                     | (race[by_seq[1:]] != race[by_seq[:-1]])])
    return number


def waves(race: np.ndarray, player: np.ndarray) -> np.ndarray:
    """Wave of each row; rows must be grouped by race in processing order.

    A race waits for the last race before it of each of its players; all races
    that wait for none are one wave, and go before the next is looked for."""
    if not len(race):
        return np.empty(0, dtype=np.int64)
    number = _race_numbers(race)
    races = number[-1] + 1
    order = np.argsort(player, kind="stable")
    before, after = order[:-1], order[1:]
    linked = (player[before] == player[after]) & (number[before] != number[after])
    source, target = number[before[linked]], number[after[linked]]
    by_source = np.argsort(source, kind="stable")
    source, target = source[by_source], target[by_source]
    first = np.searchsorted(source, np.arange(races + 1))
    waiting = np.bincount(target, minlength=races)
    out = np.empty(races, dtype=np.int64)
    ready, wave = np.flatnonzero(waiting == 0), 0
    while len(ready):
        wave += 1
        out[ready] = wave
        count = first[ready + 1] - first[ready]
        skip = np.repeat(first[ready] - np.cumsum(count) + count, count)
        freed = target[skip + np.arange(len(skip))]
        np.subtract.at(waiting, freed, 1)
        ready = np.unique(freed[waiting[freed] == 0])
    return out[number]


def waves_and_groups(race: np.ndarray, player: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wave and group of each row; rows as for `waves`. A group is what its
    races link, directly or through others, named by one of its players."""
    names, own = np.unique(player, return_inverse=True)
    number = _race_numbers(race)
    lead = own[_starts(race)][number]
    root = np.arange(len(names))
    left, right = lead, own
    while True:
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            return waves(race, player), names[root[lead]]
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def _starts(*cols: np.ndarray) -> np.ndarray:
    change = np.zeros(len(cols[0]), dtype=bool)
    change[0] = True
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _padded(values: np.ndarray, row: np.ndarray, col: np.ndarray, shape) -> np.ndarray:
    out = np.zeros(shape)
    out[row, col] = values
    return out


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    a = np.minimum(np.abs(x), 38.0)
    body = np.exp(-0.5 * a * a)
    near = body * np.polyval(_HART_NUM, a) / np.polyval(_HART_DEN, a)
    tail = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + k / tail
    upper = np.where(a < 7.07106781186547, near, body / (tail * 2.506628274631))
    return np.where(x > 0, 1.0 - upper, upper)


def _predicted_places(
    mu: np.ndarray, var: np.ndarray, row: np.ndarray, col: np.ndarray, counts: np.ndarray,
    beta: float, cells: int = 4_000_000,
) -> np.ndarray:
    """Place by mean chance of beating each rival, in blocks of bounded memory."""
    shape = (len(counts), int(counts.max()))
    m, v = _padded(mu, row, col, shape), _padded(var, row, col, shape)
    real = np.arange(shape[1])[None, :] < counts[:, None]
    chance = np.zeros(shape)
    noise = (counts * beta * beta)[:, None, None]
    block = max(1, cells // (shape[0] * shape[1]))
    for lo in range(0, shape[1], block):
        hi = min(lo + block, shape[1])
        gap = m[:, :, None] - m[:, None, lo:hi]
        z = gap / np.sqrt(noise + v[:, :, None] + v[:, None, lo:hi])
        chance += (_normal_cdf(z) * real[:, None, lo:hi]).sum(axis=2)
    # The chance against oneself is one half for everybody and changes nothing.
    mine = np.round(chance[row, col], CHANCE_DIGITS)
    order = np.lexsort((-mine, row))
    first = _starts(row[order], mine[order])
    size = np.diff(np.r_[first, len(mine)])
    race_first = np.r_[0, np.cumsum(counts)[:-1]]
    places = np.empty(len(mine), dtype=np.int64)
    places[order] = np.repeat(first, size) - race_first[row[order]] + 1
    return places


OUTPUT = ["pool", "seq", "race", "team", "line", "rank", "key",
          "mu0", "sigma0", "mu1", "sigma1", "predicted"]


def widened(sigma: np.ndarray, day: np.ndarray, last_day: np.ndarray, share: float,
            initial: float) -> np.ndarray:
    """Spread before a race: grown by the weeks since the last one, NaN for none."""
    weeks = np.maximum(np.floor((day - last_day) / 7) - 1, 0)
    grown = np.minimum(initial, sigma + np.where(np.isnan(weeks), 0, weeks) * share * initial)
    return np.where(sigma < initial, grown, sigma)


def fold_group(rows: pd.DataFrame, options: FoldOptions) -> pd.DataFrame:
    """Rate all races of one group.

    rows: seq, race, line, team, rank, key, weight, mu, sigma; mu and sigma
    are the state before the group. Adds mu0, sigma0, mu1, sigma1, predicted.
    With `weekly` also day and last_day, and adds day1.
    """
    p = options.params
    names = [*OUTPUT, "day1"] if options.weekly else OUTPUT
    if rows.empty:
        return pd.DataFrame(columns=names)
    race = races_in_order(rows)
    team = rows["team"].to_numpy()
    order = np.lexsort((rows["line"].to_numpy(), team, rows["rank"].to_numpy(), race))
    race = _race_numbers(race[order])
    # A race needs two teams.
    many = np.bincount(race[_starts(race, team[order])]) > 1
    order, race = order[many[race]], race[many[race]]
    if not len(order):
        return pd.DataFrame(columns=names)
    race = _race_numbers(race)
    player, keys = pd.factorize(rows["key"].to_numpy()[order])
    wave = waves(race, player)
    teams_per_race = np.bincount(race[_starts(race, team[order])])
    # Races of similar size share a padded matrix.
    size_class = np.ceil(np.log2(np.maximum(teams_per_race, 2))).astype(int)[race]
    by_wave = np.lexsort((size_class, wave))
    rows = rows.iloc[order[by_wave]].reset_index(drop=True)
    race, player, wave, size_class = (x[by_wave] for x in (race, player, wave, size_class))

    team = rows["team"].to_numpy()
    rank = rows["rank"].to_numpy(dtype=float)
    line = rows["line"].to_numpy()
    weight = rows["weight"].to_numpy(dtype=float)
    state_mu, state_sigma = np.empty(len(keys)), np.empty(len(keys))
    state_mu[player] = rows["mu"].to_numpy(dtype=float)
    state_sigma[player] = rows["sigma"].to_numpy(dtype=float)
    if options.weekly:
        day, state_day = rows["day"].to_numpy(dtype=float), np.empty(len(keys))
        state_day[player] = rows["last_day"].to_numpy(dtype=float)
    means = rows["mean"].to_numpy(dtype=float) if options.population else None

    tstart = _starts(race, team)
    trace, trank, twave, tclass = race[tstart], rank[tstart], wave[tstart], size_class[tstart]
    rstart = _starts(trace)
    rcount = np.diff(np.r_[rstart, len(tstart)])
    column = np.arange(len(tstart)) - np.repeat(rstart, rcount)
    tie_start = _starts(trace, trank)
    tie_count = np.diff(np.r_[tie_start, len(tstart)])
    tie_first = np.repeat(column[tie_start], tie_count)
    tied = np.repeat(tie_count, tie_count)
    team_size = np.diff(np.r_[tstart, len(rows)])

    n = len(rows)
    mu0, sigma0, mu1, sigma1 = np.empty(n), np.empty(n), np.empty(n), np.empty(n)
    predicted = np.full(n, -1, dtype=np.int64)
    batch = _starts(twave, tclass)
    for t0, t1 in zip(batch.tolist(), np.r_[batch[1:], len(tstart)].tolist()):
        r0 = tstart[t0]
        r1 = tstart[t1] if t1 < len(tstart) else n
        who = player[r0:r1]
        m, s = state_mu[who], state_sigma[who]
        if options.weekly:
            s = widened(s, day[r0:r1], state_day[who], options.weekly, p.sigma)
            state_day[who] = day[r0:r1]
        mu0[r0:r1], sigma0[r0:r1] = m, s
        var = s * s + p.tau * p.tau
        offsets = tstart[t0:t1] - r0
        team_mu = np.add.reduceat(m, offsets)
        team_var = np.add.reduceat(var, offsets)
        q0 = np.searchsorted(rstart, t0)
        q1 = np.searchsorted(rstart, t1)
        counts = rcount[q0:q1]
        row = np.repeat(np.arange(q1 - q0), counts)
        col = column[t0:t1]
        shape = (q1 - q0, int(counts.max()))
        if options.predict == "before":
            raw = np.add.reduceat(s * s, offsets)
            places = _predicted_places(team_mu, raw, row, col, counts, p.beta)
            predicted[r0:r1] = np.repeat(places, team_size[t0:t1])

        c = np.sqrt(np.add.reduceat(team_var + p.beta**2, rstart[q0:q1] - t0))[row]
        # Only ratios of exponentials matter: shift by the race's best mean.
        top = np.full(q1 - q0, -np.inf)
        np.maximum.at(top, row, team_mu)
        e = np.exp((team_mu - top[row]) / c)
        matrix = _padded(e, row, col, shape)
        behind = np.cumsum(matrix[:, ::-1], axis=1)[:, ::-1]
        s_q = behind[row, tie_first[t0:t1]]
        a_q = tied[t0:t1].astype(float)
        last_tie = tie_first[t0:t1] + tied[t0:t1] - 1
        sum_x = np.cumsum(_padded(1.0 / (a_q * s_q), row, col, shape), axis=1)[row, last_tie]
        sum_y = np.cumsum(_padded(1.0 / (a_q * s_q * s_q), row, col, shape), axis=1)[row, last_tie]
        omega = team_var / c * (1.0 / a_q - e * sum_x)
        gamma = np.sqrt(team_var) / c
        delta = gamma * team_var / (c * c) * (e * sum_x - e * e * sum_y)

        size = team_size[t0:t1]
        omega, delta = np.repeat(omega, size), np.repeat(delta, size)
        share = var / np.repeat(team_var, size)
        w = weight[r0:r1]
        if options.population:
            of = np.repeat(row, size)
            w = (np.bincount(of, m) / np.bincount(of))[of] / means[r0:r1]
        gain = np.where(omega >= 0, w, 1.0 / w)
        new_mu = m + share * omega * gain
        new_sigma = np.sqrt(var) * np.sqrt(np.maximum(1.0 - share * delta * gain, p.kappa))
        mu1[r0:r1], sigma1[r0:r1] = new_mu, new_sigma
        # Someone listed twice in a race keeps the result of the last line.
        by_line = np.argsort(line[r0:r1], kind="stable")
        state_mu[who[by_line]], state_sigma[who[by_line]] = new_mu[by_line], new_sigma[by_line]
        if options.predict == "after":
            tm = np.add.reduceat(new_mu, offsets)
            tv = np.add.reduceat(new_sigma**2, offsets)
            places = _predicted_places(tm, tv, row, col, counts, p.beta)
            predicted[r0:r1] = np.repeat(places, size)

    out = rows[OUTPUT[:7]].copy()
    out["mu0"], out["sigma0"], out["mu1"], out["sigma1"] = mu0, sigma0, mu1, sigma1
    out["predicted"] = pd.Series(predicted, dtype="Int64").where(predicted > 0)
    if options.weekly:
        out["day1"] = day
    return out


def normalised_weights(raw: list[float], low: float = 1.0, high: float = 2.0) -> list[float]:
    """Team weights mapped to [low, high]; a single weight becomes `high`."""
    if len(raw) == 1:
        return [high]
    spread = (max(raw) - min(raw)) or 0.0001
    return [(w - min(raw)) / spread * (high - low) + low for w in raw]


def chance_partial(own: pd.DataFrame, rivals: pd.DataFrame, beta: float) -> pd.DataFrame:
    """Summed chance of each own team against the given rivals of its race."""
    mu, var = own["tm"].to_numpy(dtype=float), own["tv"].to_numpy(dtype=float)
    other, other_var = rivals["tm"].to_numpy(dtype=float), rivals["tv"].to_numpy(dtype=float)
    noise = own["n"].to_numpy(dtype=float)[:, None] * beta * beta
    chance = np.zeros(len(own))
    block = max(1, 2_000_000 // len(own))
    for lo in range(0, len(rivals), block):
        part = slice(lo, lo + block)
        z = (mu[:, None] - other[None, part]) / np.sqrt(noise + var[:, None] + other_var[None, part])
        chance += _normal_cdf(z).sum(axis=1)
    return pd.DataFrame({"chance": chance})
