"""Cheapest edits of a conversation by Bertsekas' auction algorithm for shortest paths.

Node (i, q) stands before row i with the output so far in state q: nothing yet, a system row, a
user row, an assistant row. Arcs are edits with whole costs. Every node has a price; no arc may
cost less than the fall in price along it. A path grows from its origin along an arc whose
cost equals that fall (extension); where there is none, the price of the path's last node is raised
to the least cost plus price over its arcs, and the path gives that node up (contraction). Once a
path arrives, the origin's price is its distance and every cheapest path runs over tight arcs only
(cost equal to the fall in price). Tracing them by least letter gives the least audit.

Origins are taken window by window from the end, and a path stops at the nodes of the next window,
whose prices are settled; so the work grows with the rows and not with their square.
"""

from __future__ import annotations

from collections.abc import Sequence

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = (NOTHING, SYSTEM, USER, ASSISTANT)
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

RECAST, REMOVE, ADD, CUT_OFF = 3, 4, 3, 3
FAR = 1 << 60
WINDOW = 16

#: Prices behind the last row: what added rows cost until the output may end, and their letters.
END_PRICES = (0, 2 * ADD, ADD, 0)
END_LETTERS = ("", "II", "I", "")


def after(state: int, initial: str) -> int | None:
    """The state after a further role, or none where that role may not stand."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def wanted(state: int) -> str:
    """The role that an added or recast row gets in a state."""
    return "assistant" if state == USER else "user"


def code(initial: str, fault: int) -> int:
    """A row's kind as one byte: its role's initial (0 for another one) and its fault."""
    return (("sua".find(initial) + 1) if initial else 0) | fault << 2


def _arcs(kind: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, step in node numbers) of every edit, letters ascending."""
    initial, fault = " sua"[kind & 3], kind >> 2
    step = {}
    step["D"] = (REMOVE, 4)
    made = after(state, wanted(state)[0])
    step["I"] = (ADD, made - state)
    if fault not in (BLANK, DUPLICATE):
        extra = CUT_OFF if fault == TRUNCATED else 0
        kept = after(state, initial)
        if kept is not None:
            step["K"] = (extra, 4 + kept - state)
        step["R"] = (RECAST + extra, 4 + made - state)
    return [(letter, *step[letter]) for letter in "DIKR" if letter in step]


ARCS = [[_arcs(kind, state) for state in STATES] for kind in range(16)]
#: The least that a row of a kind costs, whatever happens around it.
LEAST = [
    min(cost for state in STATES for letter, cost, _ in ARCS[kind][state] if letter != "I")
    for kind in range(16)
]


def settle(codes: Sequence[int], end: Sequence[int], entries: Sequence[int]) -> list[int]:
    """Prices of all nodes, exact for the entry nodes and all nodes on their cheapest paths.

    ``end`` gives the prices behind the last row, ``entries`` the states before the first.
    """
    n = len(codes)
    price = [0] * (4 * n) + list(end)
    for first in range((n - 1) // WINDOW * WINDOW, -1, -WINDOW):
        stop = 4 * min(first + WINDOW, n)
        level = min(price[stop : stop + 4])
        for i in range(stop // 4 - 1, first - 1, -1):
            level += LEAST[codes[i]]
            price[4 * i : 4 * i + 4] = [level] * 4
        for state in STATES if first else entries:
            path = [4 * first + state]
            while path[-1] < stop:
                node = path[-1]
                best, to = FAR * 2, node
                for _, cost, step in ARCS[codes[node >> 2]][node & 3]:
                    value = cost + price[node + step]
                    if value < best:
                        best, to = value, node + step
                if price[node] < best:
                    price[node] = best
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(to)
    return price


def trace(
    codes: Sequence[int], price: list[int], entry: int, dead: set[int] | None = None
) -> tuple[str, int]:
    """The least audit over tight arcs from an entry state, and the state behind the last row."""
    last = 4 * len(codes)
    dead = set() if dead is None else dead
    node, letters = entry, []
    passed: list[int] = []
    while node < last:
        for letter, cost, step in ARCS[codes[node >> 2]][node & 3]:
            to = node + step
            if to not in dead and price[node] == cost + price[to]:
                passed.append(node)
                letters.append(letter)
                node = to
                break
        else:
            dead.add(node)
            node = passed.pop()
            letters.pop()
    return "".join(letters), node - last


def exits(codes: Sequence[int]) -> list[list[int]]:
    """Least cost from every state before the rows to every state behind them (``FAR``: none).

    Additions behind the last row are left to what follows. The first two states are only
    entered by removals and one kept system row; the other two are settled by auction.
    """
    n = len(codes)
    out = [[FAR] * 4 for _ in STATES]
    out[NOTHING][NOTHING] = out[SYSTEM][SYSTEM] = REMOVE * n
    keeps = [cost for c in codes for letter, cost, step in ARCS[c][NOTHING]
             if letter == "K" and step == 4 + SYSTEM]
    if keeps:
        out[NOTHING][SYSTEM] = REMOVE * (n - 1) + min(keeps)
    for target in (USER, ASSISTANT):
        end = [0 if state == target else FAR for state in STATES]
        price = settle(codes, end, STATES)
        for state in STATES:
            out[state][target] = price[state]
    return out


def edited(
    letters: str, entry: int, roles: Sequence[str], texts: Sequence[str]
) -> tuple[list[dict], int]:
    """The rows that an audit leaves, from an entry state, and the state behind them."""
    out, state, i = [], entry, 0
    for letter in letters:
        if letter == "D":
            i += 1
            continue
        role = roles[i] if letter == "K" else wanted(state)
        out.append({"role": role, "text": "" if letter == "I" else texts[i]})
        state = after(state, role[:1])
        i += letter != "I"
    return out, state
