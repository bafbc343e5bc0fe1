"""Sequential algorithms on small graphs, for tests to hold the distributed ones against."""

import heapq
from collections import defaultdict, deque


def greedy(n, pairs):
    """Community of each of n nodes: the two communities that gain most are joined, until none gains."""
    m = len(pairs)
    own = list(range(n))
    if not m:
        return own
    between: list[dict[int, int]] = [defaultdict(int) for _ in range(n)]
    degree = [0] * n
    for a, b in pairs:
        between[a][b] += 1
        between[b][a] += 1
        degree[a] += 1
        degree[b] += 1
    gain = lambda a, b: between[a][b] / m - degree[a] * degree[b] / (2 * m * m)
    heap = [(-gain(a, b), a, b) for a in range(n) for b in between[a] if a < b]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        g, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or b not in between[a] or abs(-g - gain(a, b)) > 1e-15:
            continue
        if -g <= 1e-15:
            break
        alive[b] = False
        own[b] = a
        degree[a] += degree[b]
        for c, x in between[b].items():
            del between[c][b]
            if c != a:
                between[a][c] += x
                between[c][a] += x
        between[b] = defaultdict(int)
        for c in list(between[a]):
            heapq.heappush(heap, (-gain(a, c), min(a, c), max(a, c)))

    def top(x):
        while own[x] != x:
            own[x] = own[own[x]]
            x = own[x]
        return x

    return [top(x) for x in range(n)]


def louvain(n, pairs):
    """Community of each of n nodes: moves in the order of nodes, level by level."""
    weight: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
    for a, b in pairs:
        weight[a][b] += 1
        weight[b][a] += 1
    m2 = 2.0 * len(pairs)
    of = list(range(n))
    loops = [0.0] * n
    level = list(range(n))
    while m2:
        size = len(weight)
        at = list(range(size))
        degree = [sum(weight[k].values()) + loops[k] for k in range(size)]
        total = degree[:]
        moved = again = True
        moved = False
        while again:
            again = False
            for k in range(size):
                near: dict[int, float] = defaultdict(float)
                for j, w in weight[k].items():
                    near[at[j]] += w
                total[at[k]] -= degree[k]
                best = max(sorted(set(near) | {at[k]}), key=lambda c: (round(near[c] - total[c] * degree[k] / m2, 12), c == at[k]))
                if best != at[k]:
                    at[k], again, moved = best, True, True
                total[at[k]] += degree[k]
        if not moved:
            break
        names = {c: i for i, c in enumerate(sorted(set(at)))}
        level = [names[at[x]] for x in level]
        new: list[dict[int, float]] = [defaultdict(float) for _ in names]
        inner = [0.0] * len(names)
        for k in range(size):
            inner[names[at[k]]] += loops[k]
            for j, w in weight[k].items():
                a, b = names[at[k]], names[at[j]]
                if a == b:
                    inner[a] += w
                else:
                    new[a][b] += w
        weight, loops = new, inner
    first: dict[int, int] = {}
    for x in range(n):
        first.setdefault(level[x], x)
        of[x] = first[level[x]]
    return of


def modularity(of, pairs):
    m = len(pairs)
    inner, degree = defaultdict(int), defaultdict(int)
    for a, b in pairs:
        degree[of[a]] += 1
        degree[of[b]] += 1
        inner[of[a]] += of[a] == of[b]
    return sum(inner[c] / m - (degree[c] / (2 * m)) ** 2 for c in degree)


def betweenness(n, pairs, directed=False):
    """Scores by counting shortest paths from every node, each pair of ends apart."""
    near = [set() for _ in range(n)]
    for a, b in pairs:
        near[a].add(b)
        if not directed:
            near[b].add(a)
    dist, paths = [], []
    for s in range(n):
        d, p, queue = {s: 0}, defaultdict(int, {s: 1}), deque([s])
        while queue:
            x = queue.popleft()
            for y in near[x]:
                if y not in d:
                    d[y] = d[x] + 1
                    queue.append(y)
                if d[y] == d[x] + 1:
                    p[y] += p[x]
        dist.append(d)
        paths.append(p)
    score = [0.0] * n
    for s in range(n):
        for t in dist[s]:
            for v in dist[s]:
                if v not in (s, t) and s != t and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                    score[v] += paths[s][v] * paths[v][t] / paths[s][t]
    return [x / ((n - 1) * (n - 2)) for x in score]


def ways(near, s, t):
    """Most ways from s to t without a common node, by plain augmenting on the graph with each node split in two."""
    room = defaultdict(int)
    next_to = defaultdict(set)
    for a in near:
        arcs = [((a, "out"), (b, "in")) for b in near[a]] + ([((a, "in"), (a, "out"))] if a not in (s, t) else [])
        for x, y in arcs:
            room[x, y] += 1
            next_to[x].add(y)
            next_to[y].add(x)
    found = 0
    while True:
        come, queue = {(s, "out"): None}, deque([(s, "out")])
        while queue and (t, "in") not in come:
            x = queue.popleft()
            for y in next_to[x]:
                if room[x, y] > 0 and y not in come:
                    come[y] = x
                    queue.append(y)
        if (t, "in") not in come:
            return found
        y = (t, "in")
        while come[y] is not None:
            room[come[y], y] -= 1
            room[y, come[y]] += 1
            y = come[y]
        found += 1
