"""Canonical forms against all permutations."""

import random
import time
from itertools import permutations

from graphloom.functions.canonical import canonical_code


def least(n, arcs, labels):
    return min((tuple(labels[v] for v in p), tuple(sorted((p.index(a), p.index(b), t) for a, b, t in arcs))) for p in permutations(range(n)))


def shuffled(r, n, arcs, labels):
    p = r.sample(range(n), n)
    return [(p[a], p[b], t) for a, b, t in arcs], [labels[p.index(i)] for i in range(n)]


def test_equal_codes_are_isomorphic_graphs():
    r = random.Random(6)
    for n, rounds in ((1, 3), (3, 60), (4, 120), (5, 120), (6, 60), (7, 12)):
        by_code, by_form = {}, {}
        for k in range(rounds):
            labels = [r.choice(["", "x"]) for _ in range(n)] if k % 2 else ["x"] * n
            arcs = sorted({(a, b, r.choice("st") if k % 3 else "s") for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 2 * n))) if a != b})
            code, form = canonical_code(n, arcs, labels), least(n, arcs, labels)
            assert by_code.setdefault(code, form) == form and by_form.setdefault(form, code) == code
            other, named = shuffled(r, n, arcs, labels)
            assert canonical_code(n, other, named) == code


def symmetric(n, joined):
    return [(a, b, "e") for a in range(n) for b in range(n) if a != b and joined(a, b)]


def test_symmetric_graphs_of_twenty_nodes_take_no_time():
    r = random.Random(9)
    ring = symmetric(20, lambda a, b: (a - b) % 20 in (1, 19))
    rings = symmetric(20, lambda a, b: a // 10 == b // 10 and (a - b) % 10 in (1, 9))
    prism = symmetric(20, lambda a, b: (a // 10 == b // 10 and (a - b) % 10 in (1, 9)) or (a - b) % 20 == 10)
    mobius = symmetric(20, lambda a, b: (a - b) % 20 in (1, 19, 10))
    full = symmetric(20, lambda a, b: True)
    sides = symmetric(20, lambda a, b: a % 2 != b % 2)
    codes = []
    for arcs in (ring, rings, prism, mobius, full, sides, []):
        began = time.process_time()
        code = canonical_code(20, arcs, ["x"] * 20)
        assert time.process_time() - began < 2
        other, labels = shuffled(r, 20, arcs, ["x"] * 20)
        assert canonical_code(20, other, labels) == code
        codes.append(code)
    assert len(set(codes)) == 7
    assert canonical_code(0, [], []) == "|" and canonical_code(2, [(0, 1, "t"), (0, 1, "t")], [None, "a"]) == ",a|0>1:t"


def test_regular_graphs_that_refinement_cannot_split():
    """The 4 x 4 rook's graph and Shrikhande's: both regular with the same counts of shared neighbours."""
    cell = lambda v: divmod(v, 4)
    rook = symmetric(16, lambda a, b: cell(a)[0] == cell(b)[0] or cell(a)[1] == cell(b)[1])
    step = {(0, 1), (0, 3), (1, 0), (3, 0), (1, 1), (3, 3)}
    other = symmetric(16, lambda a, b: tuple((x - y) % 4 for x, y in zip(cell(a), cell(b), strict=True)) in step)
    assert len(rook) == len(other) == 96
    r = random.Random(2)
    a, b = canonical_code(16, rook, [""] * 16), canonical_code(16, other, [""] * 16)
    assert a != b and canonical_code(16, shuffled(r, 16, rook, [""] * 16)[0], [""] * 16) == a and canonical_code(16, shuffled(r, 16, other, [""] * 16)[0], [""] * 16) == b
