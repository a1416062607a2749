import random
from itertools import permutations

import pytest

from lattica.operators.pattern import Growth, Pattern, brute_force_code, grow

PATH = Pattern.of([1, 2, 1], [(0, 1, 0), (1, 2, 0)])
TRIANGLE = Pattern.of([0, 0, 0], [(0, 1, 0), (1, 2, 0), (0, 2, 0)])


def shuffled(p, order):
    return Pattern.of([p.labels[order.index(i)] for i in range(p.n_vertices)], [(order[u], order[v], el) for u, v, el in p.edges])


def random_pattern(rng, n):
    edges = [(rng.randrange(i), i, rng.randrange(2)) for i in range(1, n)] + [(*sorted(rng.sample(range(n), 2)), rng.randrange(2)) for _ in range(rng.randrange(3))]
    return Pattern.of([rng.randrange(2) for _ in range(n)], edges)


def test_codes_are_equal_for_every_order():
    square = Pattern.of([0, 0, 0, 0], [(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 0), (0, 2, 0)])
    for p in (PATH, TRIANGLE, square, Pattern.of([5, 1, 1, 1], [(0, 1, 2), (0, 2, 0), (0, 3, 2)])):
        assert {shuffled(p, list(o)).code for o in permutations(range(p.n_vertices))} == {p.code}


def test_codes_part_patterns_as_brute_force_does():
    rng = random.Random(1)
    found = [random_pattern(rng, rng.randrange(2, 6)) for _ in range(250)]
    by_code, by_force = {}, {}
    for k, p in enumerate(found):
        by_code.setdefault(p.code, set()).add(k)
        by_force.setdefault(brute_force_code(p), set()).add(k)
    assert sorted(map(sorted, by_code.values())) == sorted(map(sorted, by_force.values()))


@pytest.mark.parametrize("n", [3, 5, 8])
def test_codes_of_stars_cliques_rings_and_long_paths(n):
    rng = random.Random(42)
    star = Pattern.of([9] + [1] * n, [(0, i, 0) for i in range(1, n + 1)])
    clique = Pattern.of([1] * n, [(i, j, 0) for i in range(n) for j in range(i)])
    ring = Pattern.of([1] * n, [(i, (i + 1) % n, 0) for i in range(n)])
    path = Pattern.of([1] * 12, [(i, i + 1, 0) for i in range(11)])
    for p in (star, clique, ring, path):
        for _ in range(10):
            order = list(range(p.n_vertices))
            rng.shuffle(order)
            assert shuffled(p, order).code == p.code
    assert len({star.code, clique.code, ring.code, path.code}) == (4 if n > 3 else 3)


def test_labels_and_edge_labels_tell_patterns_apart():
    assert Pattern.single_edge(1, 2).code == Pattern.single_edge(2, 1).code != Pattern.single_edge(1, 2, 1).code
    assert Pattern.single_edge(-3, 2, -1).code != Pattern.single_edge(3, 2, -1).code


def test_algebra():
    assert PATH.degree(1) == 2 and PATH.neighbours(1) == [0, 2] and PATH.edge_label(0, 2) is None
    assert PATH.with_chord(0, 2).n_edges == 3 and PATH.with_leaf(0, 7, 4).edge_label(0, 3) == 4
    assert [p.code for p in PATH.smaller()] == [Pattern.single_edge(1, 2).code] * 2
    assert [p.code for p in TRIANGLE.smaller()] == [Pattern.of([0, 0, 0], [(0, 1, 0), (1, 2, 0)]).code] * 3
    assert len(TRIANGLE.two_edge_parts()) == 3 and Pattern.of([0, 0, 0, 0], [(0, 1, 0), (1, 2, 0), (2, 3, 0)]).two_edge_parts()[0].n_edges == 2
    assert Pattern.of([0, 1], [(0, 1, 0), (1, 0, 5)]).edges == ((0, 1, 5),)
    assert PATH.to_text() == "v 0 1\nv 1 2\nv 2 1\ne 0 1 0\ne 1 2 0\n"
    path4 = Pattern.of([0] * 4, [(0, 1, 0), (1, 2, 0), (2, 3, 0)])
    assert len(path4.smaller()) == 2


def test_growth_needs_present_triples():
    got = list(grow(Pattern.single_edge(1, 2), [1, 2], [0], {(1, 2, 0)}))
    assert [(g.kind, g.u, g.label) for g in got] == [("leaf", 0, 2), ("leaf", 1, 1)]
    chords = [g for g in grow(PATH, [1, 2], [0], {(1, 1, 0), (1, 2, 0)}) if g.kind == "chord"]
    assert chords == [Growth(PATH.with_chord(0, 2), "chord", 0, 2, 1, 0)]
