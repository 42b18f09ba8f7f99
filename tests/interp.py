"""A plain interpreter of synchronous supersteps, to hold the engine against."""

from __future__ import annotations

from collections import defaultdict


def supersteps(ids, edges, *, initial, signal, collect, score, threshold, steps, fold=False):
    """edges: {(src, dst): weight}. signal(state, last, weight, out_weight, out_degree) may be None. collect(state, signals). score(state, last, ever)."""
    state = {v: initial(v) for v in ids}
    last, ever = dict.fromkeys(ids), dict.fromkeys(ids, False)
    out = defaultdict(list)
    for (s, d), w in edges.items():
        out[s].append((d, w))
    inbox = defaultdict(dict)
    queue = {v for v in ids if (score(state[v], last[v], ever[v]) or 0) > threshold}
    done = 0
    while done < steps:
        messages = defaultdict(list)
        for v in queue:
            total = sum(w for _, w in out[v])
            for d, w in out[v]:
                m = signal(state[v], last[v], w, total, len(out[v]))
                if m is not None:
                    messages[d].append((v, m))
        for v in queue:
            last[v], ever[v] = state[v], True
        queue = set()
        for d, got in messages.items():
            inbox[d].update(got)
            state[d] = collect(state[d], [m for _, m in got] if fold else list(inbox[d].values()))
            if (score(state[d], last[d], ever[d]) or 0) > threshold:
                queue.add(d)
        done += 1
        if not queue:
            break
    return state, done
