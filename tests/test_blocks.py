"""Block algebra against a model: a block list is the set of its positions, and its edges."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import blocks as B


@pytest.fixture(scope="module")
def ask(spark):
    one = spark.range(1)

    def run(*columns):
        row = one.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        out = [[(x.s, x.e) for x in v] if isinstance(v, list) and (not v or hasattr(v[0], "s")) else v for v in row]
        return out[0] if len(out) == 1 else out

    return run


@pytest.fixture(scope="module")
def each(spark):
    """The values of functions of a column of numbers or of block lists."""

    def run(values, *columns):
        kind = "i int" if all(isinstance(v, int) for v in values) else "q array<struct<s:bigint,e:bigint>>"
        rows = spark.createDataFrame([(v,) for v in values], kind).coalesce(1).select(*[c(F.col(kind[0])).alias(f"c{k}") for k, c in enumerate(columns)]).collect()
        out = [list(x) for x in zip(*rows, strict=True)]
        return out[0] if len(out) == 1 else out

    return run


L = B.literal
SEEDS = range(3)


def made(seed, most=400, blocks=None):
    """Sorted, disjoint blocks; some touch."""
    r = random.Random(seed)
    n = blocks or r.randint(1, 6)
    edges = sorted(r.sample(range(3, most), 2 * n))
    out = [list(x) for x in zip(edges[::2], edges[1::2], strict=True)]
    for a, b in zip(out[:-1], out[1:], strict=True):
        if r.random() < 0.2:
            a[1] = b[0]
    return [tuple(x) for x in out]


def places(b):
    return [p for s, e in b for p in range(s, e)]


def spans(positions, near=0):
    """The blocks of a set of positions; gaps of up to `near` are filled."""
    out = []
    for p in sorted(set(positions)):
        if out and p - out[-1][1] <= near:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", SEEDS)
def test_length_index_and_position(ask, each, seed):
    b = made(seed, 90)
    at = places(b)
    n = len(at)
    assert ask(B.length(L(b))) == n
    assert each(range(-n - 1, n + 1), lambda i: B.position(L(b), i), lambda i: B.position(L(b), i, True)) == [[None, *at, *at, None], [None, *at[::-1], *at[::-1], None]]
    assert each(range(95), lambda i: B.index(L(b), i), lambda i: B.index(L(b), i, True), lambda i: B.includes(L(b), i)) == [[at.index(p) if p in at else None for p in range(95)], [n - 1 - at.index(p) if p in at else None for p in range(95)], [p in at for p in range(95)]]


@pytest.mark.parametrize("seed", SEEDS)
def test_move_gaps_suture_and_fusion(ask, seed):
    r = random.Random(seed + 100)
    a, b = made(seed), made(seed + 50)
    step = r.randint(-3, 40)
    near = r.randint(1, 30)
    mixed = a + b
    r.shuffle(mixed)
    got = ask(B.move(L(a), step), B.gaps(L(a)), B.suture(L(mixed)), B.suture(L(mixed), near), B.fusion(L(a), L(b)))
    assert got[0] == [(s + step, e + step) for s, e in a]
    assert got[1] == [(x[1], y[0]) for x, y in zip(a[:-1], a[1:], strict=True)]
    assert got[2] == got[4] == spans(places(mixed)) and got[3] == spans(places(mixed), near)


def test_shifts_below_zero_and_lists_without_blocks(ask):
    assert ask(B.move(L([(3, 9)]), -3), B.move(L([(3, 9)]), -4), B.length(L([])), B.gaps(L([])), B.gaps(L([(3, 9)])), B.suture(L([]))) == [[(0, 6)], None, 0, [], [], []]
    with pytest.raises(Exception, match="zero"):
        ask(B.move(L([(3, 9)]), -4, strict=True))
    with pytest.raises(Exception, match="outside"):
        ask(B.index(L([(3, 9), (14, 17)]), F.lit(11), strict=True))


@pytest.mark.parametrize("seed", SEEDS)
def test_contains_is_inclusion_of_positions(each, seed):
    r = random.Random(seed + 7)
    b = made(seed, 120)
    cases = [[]]
    for _ in range(12):
        s, e = r.choice(b)
        x = sorted(r.sample(range(s, e + 1), 2)) if e - s > 1 else [s, e]
        cases.append([(max(0, x[0] - r.choice((0, 0, 1))), x[1] + r.choice((0, 0, 1)))])
    assert each(cases, lambda q: B.contains(L(b), q)) == [set(places(q)) <= set(places(b)) for q in cases]


def fits(ref, query):
    """Each block of the query lies in a block of ref; where another one goes before (or behind), it starts (or ends) with it."""
    return all(any(s <= x and y <= e and (i == 0 or x == s) and (i == len(query) - 1 or y == e) for s, e in ref) for i, (x, y) in enumerate(query))


@pytest.mark.parametrize("seed", SEEDS)
def test_coincides(each, seed):
    r = random.Random(seed + 20)
    ref = made(seed, 300, 5)
    cases = [[]]
    for _ in range(25):
        q = [list(x) for x in sorted(r.sample(ref, r.randint(1, 4)))]
        q[0][0] += r.choice((0, 1, -1))
        q[-1][1] += r.choice((0, -1, 1))
        if r.random() < 0.4:
            q[r.randrange(len(q))][r.randrange(2)] += r.choice((-1, 1))
        if all(0 <= s < e for s, e in q) and all(x[1] <= y[0] for x, y in zip(q[:-1], q[1:], strict=True)):
            cases.append([tuple(x) for x in q])
    want = [fits(ref, q) for q in cases]
    assert each(cases, lambda q: B.coincides(L(ref), q)) == want


def test_both_answers_occur(each):
    ref = [(7, 19), (33, 48), (61, 90)]
    good = [[(9, 11)], [(12, 19), (33, 35)], [(7, 19), (33, 48), (61, 62)], [(18, 19), (61, 70)]]
    bad = [[(6, 11)], [(12, 18), (33, 35)], [(12, 19), (34, 48), (61, 70)], [(20, 30)], [(12, 19), (33, 48), (60, 70)]]
    assert each(good + bad, lambda q: B.coincides(L(ref), q)) == [True] * len(good) + [False] * len(bad) == [fits(ref, q) for q in good + bad]


@pytest.mark.parametrize("seed", SEEDS)
def test_clip(ask, seed):
    r = random.Random(seed + 31)
    b, template = made(seed, 200), made(seed + 60, 260)
    low, high = sorted(r.sample(range(0, 260), 2))
    inside = [(max(s, low), min(e, high)) for s, e in b if max(s, low) < min(e, high)]
    assert ask(B.clip(L(b), low, high)) == inside
    # what the window has beyond b: all of it, or what the template has there, and beyond the template's edges
    before, after = set(range(low, min(b[0][0], high))), set(range(max(b[-1][1], low), high))
    own, held = set(places(inside)), set(places(template))
    edges = {p for p in before if p < template[0][0]} | {p for p in after if p >= template[-1][1]}
    got = ask(B.clip_extend(L(b), low, high), B.clip_extend(L(b), low, high, left=False), B.clip_extend(L(b), low, high, right=False), B.clip_extend(L(b), low, high, L(template)), B.clip_extend(L(b), low, high, L(template), supply=True))
    beyond = before | after
    assert got == [spans(x) for x in (own | beyond, own | after, own | before, own | (beyond & held), own | (beyond & held) | edges)]


def test_windows_that_are_none(ask):
    assert ask(B.clip(L([(4, 9)]), 6, 6), B.clip(L([(4, 9)]), -1, 6), B.clip(L([(4, 9)]), 9, 12)) == [None, None, []]


def test_validity(ask, each):
    def valid(b):
        at = 0
        for s, e in b:
            if s < at or s >= e:
                return False
            at = e
        return bool(b)

    r = random.Random(3)
    cases = [[], [(0, 1)], [(-2, 4)], [(5, 5)], [(4, 2)]] + [made(k) for k in range(8)] + [[tuple(r.choices(range(30), k=2)) for _ in range(r.randint(1, 3))] for _ in range(20)]
    assert each(cases, B.is_valid, B.is_sorted) == [[valid(b) for b in cases], [b == sorted(b) for b in cases]]
    assert ask(B.sort(L([(8, 9), (2, 5), (2, 3)])), B.check(L([(2, 5), (8, 9)])), B.check_sorted(L([(2, 5), (8, 9)]))) == [[(2, 3), (2, 5), (8, 9)], [(2, 5), (8, 9)], [(2, 5), (8, 9)]]
    for bad in (B.check(L([(9, 4)])), B.check_sorted(L([(30, 31), (2, 4)]))):
        with pytest.raises(Exception, match="blocks"):
            ask(bad)


def test_compare(ask):
    introns = [(220, 340), (401, 590)]
    make = lambda s, e: list(zip([s, *[y for _, y in introns]], [*[x for x, _ in introns], e], strict=True))
    ref = make(100, 700)
    # ends that differ by more than 50
    for s, e, want in ((100, 700, 0), (150, 650, 0), (151, 700, 2), (49, 700, 2), (120, 751, 1), (10, 649, 3)):
        assert tuple(ask(B.compare(L(ref), L(make(s, e))))) == (B.FULL_MATCH, want)
    assert tuple(ask(B.compare(L(ref), L(make(10, 700)), 100))) == (B.FULL_MATCH, 0)
    for other in ([(100, 221), *ref[1:]], ref[:1], [ref[0], ref[2]]):
        assert tuple(ask(B.compare(L(ref), L(other)))) == (None, None)
    one = [(60, 80)]
    assert [ask(B.compare(L(one), L(q)))[0] for q in ([(79, 95)], [(80, 95)], [(10, 20), (70, 75)])] == [B.OVERLAP, B.NOT_OVERLAP, B.OVERLAP]


@pytest.mark.parametrize("seed", SEEDS)
def test_text_round_trip(ask, seed):
    b = made(seed)
    assert ask(B.parse(B.text(L(b))), B.text(L(b))) == [b, ";".join(f"{s}-{e}" for s, e in b)]
