"""The cheapest edits that give a run of rows alternating roles, by a dynamic programme over persistent audits.

States: 0 nothing written, 1 after a system row, 2 after a user row, 3 after an assistant row; 0 and 3 may end. An audit is a chain of
linked nodes, one per edit, that shares its prefix with other audits. Each node knows its ancestors at distances 1, 2, 4, ... and a rolling hash of
its whole prefix, so two audits of equal cost are ordered by a search for their longest common prefix.

Audits that meet in one place have edited the same rows at the same cost, so none is a proper prefix of another, and the least one stays least whatever follows.
"""

from __future__ import annotations

from dataclasses import dataclass

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Fixed costs of the edits; a truncated row that stays costs more.
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
STATES, ENDS = range(4), (0, 3)
TURNED = (2, 2, 3, 2)                                                    # the state after a rerole or an insert
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLES = {2: "user", 3: "assistant"}
BASE, MODULUS = 1_000_003, (1 << 61) - 1
FAR = 1 << 60


class Node:
    __slots__ = ("letter", "depth", "hash", "up")

    def __init__(self, parent: "Node | None" = None, letter: str = "", modulus: int = MODULUS):
        if parent is None:
            self.letter, self.depth, self.hash, self.up = "", 0, 0, ()
            return
        self.letter, self.depth = letter, parent.depth + 1
        self.hash = (parent.hash * BASE + ord(letter)) % modulus
        up, k = [parent], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = up

    def ancestor(self, depth: int) -> "Node":
        node, k = self, 0
        distance = self.depth - depth
        while distance:
            if distance & 1:
                node = node.up[k]
            distance >>= 1
            k += 1
        return node

    def text(self) -> str:
        out, node = [], self
        while node.depth:
            out.append(node.letter)
            node = node.up[0]
        return "".join(reversed(out))


def _same(a: Node, b: Node) -> bool:
    """Whether two chains of equal length spell the same; ends where they share a node."""
    while a is not b:
        if a.letter != b.letter:
            return False
        if not a.depth:
            return True
        a, b = a.up[0], b.up[0]
    return True


def less(a: Node, b: Node) -> bool:
    """Whether audit a stands before b in ASCII order."""
    if a is b:
        return False
    depth = min(a.depth, b.depth)
    x, y = a.ancestor(depth), b.ancestor(depth)
    if x.hash == y.hash:                                                 # one seems to begin the other
        return a.depth < b.depth if _same(x, y) else a.text() < b.text()
    k = len(x.up) - 1
    while k >= 0:
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
        k -= 1
    if _same(x.up[0], y.up[0]):                                          # the prefix that hashes call common is common
        return x.letter < y.letter
    return a.text() < b.text()


@dataclass(slots=True)
class Row:
    initial: str
    forced: bool                                                         # blank or duplicate: has to go
    truncated: bool


class Cells:
    """For each state the least cost and, of the audits at that cost, the least one."""

    __slots__ = ("cost", "node", "modulus")

    def __init__(self, entry: int, modulus: int = MODULUS):
        self.cost, self.node, self.modulus = [FAR] * 4, [None] * 4, modulus
        self.cost[entry], self.node[entry] = 0, Node()

    def _offer(self, cost: list, node: list, state: int, price: int, parent: Node, letter: str) -> None:
        if price > cost[state]:
            return
        new = Node(parent, letter, self.modulus)
        if price < cost[state] or less(new, node[state]):
            cost[state], node[state] = price, new

    def insert(self) -> None:
        """Inserted rows; two in a row are the most that can help."""
        for _ in range(2):
            for state in STATES:
                if self.cost[state] < FAR:
                    self._offer(self.cost, self.node, TURNED[state], self.cost[state] + INSERT_COST, self.node[state], INSERT)

    def row(self, row: Row) -> None:
        self.insert()
        cost, node = [FAR] * 4, [None] * 4
        stay = TRUNCATED_COST if row.truncated else 0
        for state in STATES:
            price, chain = self.cost[state], self.node[state]
            if price >= FAR:
                continue
            self._offer(cost, node, state, price + DELETE_COST, chain, DELETE)
            if row.forced:
                continue
            kept = KEPT.get((state, row.initial))
            if kept is not None:
                self._offer(cost, node, kept, price + stay, chain, KEEP)
            self._offer(cost, node, TURNED[state], price + stay + REROLE_COST, chain, REROLE)
        self.cost, self.node = cost, node


def best(rows: list[Row], entry: int = 0, after: list[int] | None = None, modulus: int = MODULUS) -> tuple[int, int, str]:
    """(cost, exit state, audit) of the cheapest, then least audit of the rows from a state on; audits end after the last row.

    ``after`` has the cost of all that follows, for each exit state; without it the run ends here, and closing inserts belong to the audit.
    """
    cells = Cells(entry, modulus)
    for row in rows:
        cells.row(row)
    if after is None:
        cells.insert()
        after = [0 if s in ENDS else FAR for s in STATES]
    found = None
    for s in STATES:
        total = cells.cost[s] + after[s]
        if cells.cost[s] < FAR and total < FAR and (found is None or total < found[0] or total == found[0] and less(cells.node[s], cells.node[found[1]])):
            found = (total, s)
    if found is None:
        return FAR, entry, ""
    return found[0], found[1], cells.node[found[1]].text()


def costs(rows: list[Row]) -> list[list[int]]:
    """The least cost from each state before the rows to each state after the last one."""
    out = []
    for entry in STATES:
        cells = Cells(entry)
        for row in rows:
            cells.row(row)
        out.append(cells.cost)
    return out


def applied(audit: str, roles: list[str], entry: int = 0):
    """For each edit: (index of the row or None for an insert, role that it leaves, or None if the row goes), and at last the state."""
    state, at, out = entry, 0, []
    for letter in audit:
        if letter == INSERT:
            state = TURNED[state]
            out.append((None, ROLES[state]))
            continue
        if letter == DELETE:
            out.append((at, None))
        elif letter == KEEP:
            state = KEPT[(state, roles[at][:1])]
            out.append((at, roles[at]))
        else:
            state = TURNED[state]
            out.append((at, ROLES[state]))
        at += 1
    return out, state
