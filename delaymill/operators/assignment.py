"""Exact choice of events in one horizon with its dual values: a small helper run inside tasks on bounded pools.

Take ``k`` rows, at most one per journey, and maximise the sum of probabilities minus a penalty for
every row of a station beyond its preferred load. The penalty is convex, so adding one row at a time
along the best alternating path (journey, station, journey, ...) stays optimal for every ``k``.
"""

from __future__ import annotations

from collections import Counter

SCALE = 10**12


def _best_path(rows, weight, chosen, load, preferred, penalty):
    """Best way to use one more journey: (last station, entering row of each station), or None."""
    gain_j, gain_s, entry = {}, {}, {}
    moved = True
    for j, _ in rows:
        if j not in chosen:
            gain_j[j] = 0
    while moved:
        moved = False
        for i, (j, s) in enumerate(rows):
            if j in gain_j and chosen.get(j) != i:
                gain = gain_j[j] + weight[i]
                if s not in gain_s or gain > gain_s[s]:
                    gain_s[s], entry[s], moved = gain, i, True
        for j, i in chosen.items():
            s = rows[i][1]
            if s in gain_s and (j not in gain_j or gain_s[s] - weight[i] > gain_j[j]):
                gain_j[j], moved = gain_s[s] - weight[i], True
    if not gain_s:
        return None
    last = max(gain_s, key=lambda s: gain_s[s] - (penalty if load.get(s, 0) >= preferred else 0))
    return last, entry


def _plain_prefix(rows, most, preferred):
    """Rows of the first ``most`` journeys in order, unless they overload a station."""
    taken, load = {}, {}
    for i, (j, s) in enumerate(rows):
        if j not in taken and len(taken) < most:
            taken[j] = i
            load[s] = load.get(s, 0) + 1
            if load[s] > preferred:
                return None
    return list(taken.values())


def _filled(rows, worth, picks, preferred, penalty, most):
    """``picks`` and after it, up to ``most`` rows, always the row that adds most at that moment."""
    picks = list(picks)
    load = Counter(rows[i][1] for i in picks)
    taken = {rows[i][0] for i in picks}
    while len(picks) < most:
        free = [i for i, (j, _) in enumerate(rows) if j not in taken]
        if not free:
            break
        best = max(free, key=lambda i: (worth[i] - (penalty if load[rows[i][1]] >= preferred else 0), -i))
        picks.append(best)
        taken.add(rows[best][0])
        load[rows[best][1]] += 1
    return sorted(picks)


def station_prices(rows, worth, picks, preferred, penalty):
    """Dual values of a choice: the worth of a place, and what each station adds to it. None if a better choice exists.

    A row outside the choice is worth at most place and station together, as far as its journey is free. The values solve a system of differences, the
    least solution of which is the longest path to each station; it has none if some exchange of rows gains.
    """
    held = {rows[i][0]: i for i in picks}
    load = Counter(rows[i][1] for i in picks)
    place = -(len(rows) + 1) * (max(worth, default=0) + penalty + 1)  # below any path
    price = dict.fromkeys((s for _, s in rows), place)
    for _ in range(len(price) + 3):
        before = place, dict(price)
        for i, (j, s) in enumerate(rows):
            least = worth[i] if j not in held else price[rows[held[j]][1]] + worth[i] - worth[held[j]]
            price[s] = max(price[s], least)
        place = max([place, *(v - (penalty if load[s] >= preferred else 0) for s, v in price.items())])
        for s in price:
            price[s] = max(price[s], place + (penalty if load[s] > preferred else 0))
        if before == (place, price):
            fits = all(price[rows[i][1]] <= worth[i] for i in picks)
            return (place, {s: v - place for s, v in price.items()}) if fits else None
    return None


def proved_picks(probabilities, journeys, stations, preferred, penalty, capacities, steps=None):
    """For every capacity the chosen positions, the worth of a place and the price of each row's station (None without proof)."""
    rows = list(zip(journeys, stations))
    worth, fine = [round(p * SCALE) for p in probabilities], round(penalty * SCALE)
    answers = []
    for picks in optimal_picks(probabilities, journeys, stations, preferred, penalty, capacities, steps):
        found = station_prices(rows, worth, picks, preferred, fine)
        answers.append((picks, *((found[0], [found[1][s] for _, s in rows]) if found else (None, None))))
    return answers


def optimal_picks(probabilities, journeys, stations, preferred, penalty, capacities, steps=None):
    """Chosen row positions for every capacity; rows come in priority order.

    Among equal objectives the choice with the better-ranked rows wins: the last position in which two
    choices differ decides. Integer arithmetic keeps ties exact. After ``steps`` paths the search is stopped, and larger choices
    are filled up row by row.
    """
    rows = list(zip(journeys, stations))
    most = max(capacities)
    plain = _plain_prefix(rows, most, preferred)
    if plain is not None:
        return [plain[:k] for k in capacities]
    n = len(rows)
    worth, fine = [round(p * SCALE) for p in probabilities], round(penalty * SCALE)
    weight = [(w << n) - (1 << i) for i, w in enumerate(worth)]
    penalty = fine << n
    chosen, load, after = {}, {}, [[]]
    for _ in range(most if steps is None else min(steps, most)):
        path = _best_path(rows, weight, chosen, load, preferred, penalty)
        if path is None:
            break
        station, entry = path
        load[station] = load.get(station, 0) + 1
        while True:
            i = entry[station]
            journey = rows[i][0]
            previous = chosen.get(journey)
            chosen[journey] = i
            if previous is None:
                break
            station = rows[previous][1]
        after.append(sorted(chosen.values()))
    if steps is not None and steps < most:
        return [after[k] if k < len(after) else _filled(rows, worth, after[-1], preferred, fine, k) for k in capacities]
    return [after[min(k, len(after) - 1)] for k in capacities]
