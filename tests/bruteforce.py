"""Slow answers for small inputs, worked out command by command."""

import random

OPEN = 9223372036854775807


def random_log(rng: random.Random, ticks: int, size: int, ids: range):
    """``(tick, op, src, label, dst)`` rows in order."""
    ops = ["addEdge"] * 4 + ["addNode"] * 2 + ["rmvEdge"] * 3 + ["rmvNode"]
    marks = sorted(rng.randint(1, ticks) for _ in range(size))
    return [(t, rng.choice(ops), rng.choice(ids), rng.choice("ab"), rng.choice(ids)) for t in marks]


def cancelled_later(command, rest):
    """Which later commands of the tick undo an edge command."""
    _, op, src, _, dst = command
    other = "rmvEdge" if op == "addEdge" else "addEdge"
    return any(
        (o == other and (s, d) == (src, dst)) or (o == "rmvNode" and s in (src, dst)) for _, o, s, _, d in rest
    )


def removed_later(node, rest):
    return any(o == "rmvNode" and s == node for _, o, s, _, _ in rest)


def fold(log, mode):
    """Tick by tick over a dictionary of open edges; returns intervals and vertices."""
    open_edges, closed, vertices = {}, set(), {}
    for tick in sorted({c[0] for c in log}):
        batch = [c for c in log if c[0] == tick]
        opens, closes, gone, explicit, implied = set(), set(), set(), set(), set()
        for i, command in enumerate(batch):
            _, op, src, _, dst = command
            rest = batch[i + 1 :] if mode == "last_wins" else []
            if op == "rmvNode":
                gone.add(src)
            elif op == "addNode":
                if not removed_later(src, rest):
                    explicit.add(src)
            elif op == "rmvEdge":
                if not cancelled_later(command, rest):
                    closes.add((src, dst))
            elif not cancelled_later(command, rest):
                opens.add((src, dst))
        implied = {v for pair in opens for v in pair}
        for i, (_, op, src, _, dst) in enumerate(batch):
            if op == "addEdge" and mode == "last_wins":
                explicit |= {v for v in (src, dst) if v not in implied and not removed_later(v, batch[i + 1 :])}
        for pair in list(open_edges):
            if pair in closes or pair[0] in gone or pair[1] in gone:
                closed.add((*pair, open_edges.pop(pair), tick))
        for pair in opens:
            open_edges.setdefault(pair, tick)
        for attr, found in ((1, explicit), (0, implied)):
            for v in found:
                old = vertices.get(v, (0, tick))
                vertices[v] = (max(old[0], attr), old[1])
    history = closed | {(*pair, start, OPEN) for pair, start in open_edges.items()}
    return sorted(history), sorted((v, attr, first) for v, (attr, first) in vertices.items())


def run_in_order(log, bag):
    """Edges and vertices left after executing every command in turn."""
    edges, vertices = [], set()
    for _, op, src, label, dst in log:
        if op == "addEdge":
            vertices |= {src, dst}
            if bag or (src, dst, label) not in edges:
                edges.append((src, dst, label))
        elif op == "addNode":
            vertices.add(src)
        elif op == "rmvEdge":
            edges = [e for e in edges if e[:2] != (src, dst) or (bag and e[2] != label)]
        else:
            vertices.discard(src)
            edges = [e for e in edges if src not in e[:2]]
    return sorted(edges), sorted(vertices)


def relax(edges, sources, step, max_hops):
    """Least values over walks of at most ``max_hops`` edges, and the first round that reached each vertex."""
    best = dict(sources)
    hops = {v: 0 for v in best}
    for hop in range(1, max_hops + 1):
        offers = {}
        for edge in edges:
            if edge[0] in best:
                value = step(best[edge[0]], edge)
                if value is not None:
                    offers[edge[1]] = min(value, offers.get(edge[1], value))
        better = {v: x for v, x in offers.items() if v not in best or x < best[v]}
        if not better:
            break
        best.update(better)
        for v in better:
            hops.setdefault(v, hop)
    return best, hops


def rows(df):
    return sorted(tuple(row) for row in df.collect())
