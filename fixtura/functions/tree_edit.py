"""Ordered tree edit distance with the edit script, after Zhang and Shasha (1989).

Nodes are plain tuples (label, [children]); labels are any hashable value. `relabel(a, b)` is the
cost of turning one label into another; `insert` and `delete` are costs per node.
"""

from __future__ import annotations

from collections.abc import Callable

Node = tuple


def _postorder(root: Node) -> tuple[list, list[int], list[int]]:
    """Labels in postorder, the leftmost leaf of each node, and the key roots."""
    labels: list = []
    left: list[int] = []

    def visit(node: Node) -> int:
        first = None
        for child in node[1]:
            leaf = visit(child)
            first = leaf if first is None else first
        labels.append(node[0])
        left.append(len(labels) - 1 if first is None else first)
        return left[-1]

    visit(root)
    last = {leaf: i for i, leaf in enumerate(left)}
    return labels, left, sorted(last.values())


def edit_script(a: Node, b: Node, relabel: Callable, insert: float = 1.0, delete: float = 1.0) -> tuple[float, list[tuple]]:
    """The least cost of turning tree `a` into `b`, and a script that has it: tuples
    ("keep"|"relabel", label of a, label of b), ("delete", label, None), ("insert", None, label)."""
    la, lefta, rootsa = _postorder(a)
    lb, leftb, rootsb = _postorder(b)
    tree = [[0.0] * len(lb) for _ in la]

    def forest(i: int, j: int) -> list[list[float]]:
        li, lj = lefta[i], leftb[j]
        rows, cols = i - li + 2, j - lj + 2
        f = [[0.0] * cols for _ in range(rows)]
        for x in range(1, rows):
            f[x][0] = f[x - 1][0] + delete
        for y in range(1, cols):
            f[0][y] = f[0][y - 1] + insert
        for x in range(1, rows):
            u = li + x - 1
            above, row, whole_u, leaf_u, label = f[x - 1], f[x], lefta[u] == li, lefta[u] - li, la[u]
            for y in range(1, cols):
                v = lj + y - 1
                best = above[y] + delete
                other = row[y - 1] + insert
                if other < best:
                    best = other
                if whole_u and leftb[v] == lj:
                    other = above[y - 1] + relabel(label, lb[v])
                    if other < best:
                        best = other
                    tree[u][v] = best
                else:
                    other = f[leaf_u][leftb[v] - lj] + tree[u][v]
                    if other < best:
                        best = other
                row[y] = best
        return f

    for i in rootsa:
        for j in rootsb:
            whole = forest(i, j)  # the last pair is that of the roots
    script: list[tuple] = []
    todo = [(len(la) - 1, len(lb) - 1)]
    while todo:
        i, j = todo.pop()
        f = whole if (i, j) == (len(la) - 1, len(lb) - 1) else forest(i, j)
        li, lj = lefta[i], leftb[j]
        x, y = i - li + 1, j - lj + 1
        while x or y:
            u, v = li + x - 1, lj + y - 1
            if x and abs(f[x][y] - f[x - 1][y] - delete) < 1e-9:
                script.append(("delete", la[u], None))
                x -= 1
            elif y and abs(f[x][y] - f[x][y - 1] - insert) < 1e-9:
                script.append(("insert", None, lb[v]))
                y -= 1
            elif lefta[u] == li and leftb[v] == lj:
                script.append(("keep" if la[u] == lb[v] else "relabel", la[u], lb[v]))
                x, y = x - 1, y - 1
            else:
                todo.append((u, v))
                x, y = lefta[u] - li, leftb[v] - lj
    return tree[-1][-1], script[::-1]
