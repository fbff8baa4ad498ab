"""Cheapest edits of a conversation's turns by the auction shortest-path algorithm.

The lattice has a layer before each turn and, in each layer, a node for what the kept turns end with:
nothing yet, a system, a user or an assistant turn. Arcs are edits with integer costs: Keep, Rerole and
Delete take a turn to the next layer, Insert stays in the layer.

An auction keeps a price for every node, never above the cost of any arc plus the price behind it. A
path grows from its origin along the cheapest arc while that holds with equality; otherwise the price
of its last node is raised to the cheapest arc and the path draws back by one. When it arrives, the
origin's price is its exact distance. Layers are auctioned in groups from the end, each with all its
first nodes as origins, so that a path only has to reach the nodes whose price is already exact.

Arcs whose price difference is their cost are tight, and the cheapest paths are those of tight arcs
only. Following tight arcs in the order of their letters gives the cheapest path with the least letters.
"""

from __future__ import annotations

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, KEEP, REROLE = "DIKR"
COSTS = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
CUT_OFF = 3  # for leaving a turn that ends without a full stop
NEXT = (USER, USER, ASSISTANT, USER)  # what an inserted or re-roled turn is
NAMES = {USER: "user", ASSISTANT: "assistant"}
FOLLOWS = {
    ("s", NOTHING): SYSTEM,
    ("u", NOTHING): USER,
    ("u", SYSTEM): USER,
    ("u", ASSISTANT): USER,
    ("a", USER): ASSISTANT,
}
FINAL = (NOTHING, ASSISTANT)  # a whole conversation may end here
REACH = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))  # which states can follow which
INITIALS = "sua"
MUST_GO, IS_CUT_OFF, END = 8, 4, 16  # turn codes: 0 to 3 for s, u, a, other; plus these
GROUP = 16  # layers auctioned together
INFINITE = 1 << 60

Arc = tuple[str, int, int, int]  # letter, cost, layers ahead, state there


def _arcs(code: int, state: int) -> list[Arc]:
    """The edits possible in a state before a turn, in the order of their letters."""
    arcs = [(INSERT, COSTS[INSERT], 0, NEXT[state])]
    if code == END:
        return arcs + [("", 0, 1, state)] * (state in FINAL)
    arcs.insert(0, (DELETE, COSTS[DELETE], 1, state))
    if not code & MUST_GO:
        more = CUT_OFF if code & IS_CUT_OFF else 0
        initial = "suax"[code & 3]
        if (initial, state) in FOLLOWS:
            arcs.append((KEEP, COSTS[KEEP] + more, 1, FOLLOWS[initial, state]))
        arcs.append((REROLE, COSTS[REROLE] + more, 1, NEXT[state]))
    return arcs


ARCS = [[_arcs(code, state) for state in range(4)] for code in range(END + 1)]


def turn_code(role: str, must_go: bool, cut_off: bool) -> int:
    first = INITIALS.find(role[0]) if role else -1
    return (first if first >= 0 else 3) + MUST_GO * must_go + IS_CUT_OFF * (cut_off and not must_go)


def _auction(codes: list[int], prices: list[int], origin: int, end: int) -> None:
    """Raise prices until the origin's is its exact distance; layer `end` has exact prices already."""
    path = [origin]
    while True:
        node = path[-1]
        layer, state = node >> 2, node & 3
        if layer == end:
            return
        best, ahead = INFINITE, -1
        for _, cost, step, to in ARCS[codes[layer]][state]:
            to += (layer + step) << 2
            if cost + prices[to] < best:
                best, ahead = cost + prices[to], to
        if prices[node] < best or ahead < 0:
            prices[node] = best
            if len(path) > 1:
                path.pop()
            elif ahead < 0:
                return
        else:
            path.append(ahead)


def prices(codes: list[int], exits: list[int], origins: tuple[int, ...] = (0, 1, 2, 3)) -> list[int]:
    """Dual prices of all nodes (4 * layer + state) for given costs behind the last layer.

    Exact at `origins` of the first layer, at the first layer of each group, and on the cheapest paths
    from there; elsewhere a lower bound.
    """
    n = len(codes)
    found = [0] * (4 * n) + list(exits)
    for end in range(n, 0, -GROUP):
        begin = max(0, end - GROUP)
        behind = found[4 * end : 4 * end + 4]
        least = min(behind)
        found[4 * begin : 4 * end] = [
            least if any(behind[t] < INFINITE for t in REACH[s]) else INFINITE for s in range(4)
        ] * (end - begin)
        for state in range(4) if begin else origins:
            if found[4 * begin + state] < INFINITE:
                _auction(codes, found, 4 * begin + state, end)
    return found


def trace(codes: list[int], found: list[int], state: int) -> tuple[str, int]:
    """Letters of the first cheapest path from a state of the first layer, and the state it ends in.

    A tight arc off the cheapest paths can lead to a dead end, from where the search steps back; a dead
    node is never entered again.
    """
    n, path, dead = len(codes), [(state, 0, "")], set()
    while True:
        node, tried, _ = path[-1]
        layer = node >> 2
        if layer == n:
            return "".join(letter for _, _, letter in path), node & 3
        arcs = ARCS[codes[layer]][node & 3]
        for k in range(tried, len(arcs)):
            letter, cost, step, to = arcs[k]
            to += (layer + step) << 2
            if found[node] == cost + found[to] and to not in dead:
                path[-1] = (node, k + 1, path[-1][2])
                path.append((to, 0, letter))
                break
        else:
            dead.add(node)
            path.pop()


def whole(codes: list[int], state: int = NOTHING) -> tuple[str, int]:
    """Letters and cost of the cheapest edits of a whole conversation (or of its end, from `state`)."""
    codes = [*codes, END]
    found = prices(codes, [0] * 4, (state,))
    return trace(codes, found, state)[0], found[state]


def part(codes: list[int]) -> tuple[list[int], list[int]]:
    """For each first and last state of a part of a conversation (4 * first + last): the least cost,
    and the rank of its letters among those of one first state."""
    costs, letters = [INFINITE] * 16, [""] * 16
    for last in range(4):
        found = prices(codes, [0 if s == last else INFINITE for s in range(4)])
        for first in range(4):
            if found[first] < INFINITE:
                costs[4 * first + last] = found[first]
                letters[4 * first + last] = trace(codes, found, first)[0]
    ranks = [0] * 16
    for first in range(4):
        order = sorted(range(4), key=lambda last: letters[4 * first + last])
        for rank, last in enumerate(order):
            ranks[4 * first + last] = rank
    return costs, ranks


def part_letters(codes: list[int], first: int, last: int) -> str:
    found = prices(codes, [0 if s == last else INFINITE for s in range(4)], (first,))
    return trace(codes, found, first)[0]


def joined(parts: list[tuple[list[int], list[int]]]) -> tuple[list[tuple[int, int]], int]:
    """First and last state of each part on the first cheapest path through all, and the whole cost.

    Parts let nothing be inserted behind their last turn, so of two letter strings of one part none
    begins the other, and the ranks decide between equal costs.
    """
    behind = [whole([], s)[1] for s in range(4)]
    costs_behind = [behind]
    for costs, _ in reversed(parts):
        behind = [min(costs[4 * s + t] + behind[t] for t in range(4)) for s in range(4)]
        costs_behind.append(behind)
    costs_behind.reverse()
    states, state = [], NOTHING
    for (costs, ranks), behind in zip(parts, costs_behind[1:]):
        _, _, last = min((costs[4 * state + t] + behind[t], ranks[4 * state + t], t) for t in range(4))
        states.append((state, last))
        state = last
    return states, costs_behind[0][NOTHING]


def edited(turns: list[tuple[str, str]], letters: str, state: int = NOTHING) -> list[str]:
    """`role:text` of the repaired turns."""
    out, at = [], iter(turns)
    for letter in letters:
        if letter == DELETE:
            next(at)
            continue
        if letter == KEEP:
            role, text = next(at)
            state = FOLLOWS[role[0], state]
        else:
            state = NEXT[state]
            role, text = NAMES[state], next(at)[1] if letter == REROLE else ""
        out.append(f"{role}:{text}")
    return out
