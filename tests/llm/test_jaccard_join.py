"""The similarity join against brute force."""

import itertools
import random

import numpy as np
import pytest

from codeterra.llm import jaccard_join
from codeterra.operators.components import components
from tests.conftest import frame


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def check(spark, rows, **options):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame(spark, rows, "doc_id long, text string"), **options).collect()}
    assert got == brute(rows)


def test_edits_and_copies(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for group in range(12):
        base = rng.choices(words, k=rng.randint(4, 150))
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    check(spark, [*rows, (1000, None), (1001, ""), (1002, " \t "), (1003, "one two"), (1004, "ONE  two")])


def test_a_common_passage_hides_no_links(spark):
    """Many texts are mostly one passage: similar ones only meet in large groups, by rare elements or in blocks."""
    rng = random.Random(2)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(60):
        own = [f"x{k}_{i}" for i in range(rng.choice((6, 10, 14, 40)))]
        rows.append((len(rows), " ".join(own + passage)))
        if k % 4 == 0:
            own[0] = f"y{k}"
            rows.append((len(rows), " ".join(own + passage)))
    check(spark, rows)


def test_a_hot_shingle_beside_a_small_group(spark):
    """Near copies of 7 to 10 words that share one signature with 20 other texts and the rest with each other only."""
    rows = []
    for family in range(12):
        opening = [f"o{family}_{k}" for k in range(5)]
        for k in range(20):
            rows.append((len(rows), " ".join([*opening, *(f"x{family}_{k}_{i}" for i in range(6))])))
        for k, n in enumerate((7, 8, 9, 10)):
            base = [*opening, *(f"b{family}_{k}_{i}" for i in range(n - 5))]
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base, f"end{family}_{k}"]))]
    check(spark, rows)


def test_similar_sets_share_signatures():
    """At least 1 + SLACK, whatever the sizes and wherever the differences are."""
    rng = np.random.default_rng(7)
    for trial in range(3000):
        n = int(rng.integers(3, [8, 30, 200, 1500][trial % 4]))
        base = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        cut, new = int(rng.integers(0, 1 + len(base) // 6)), int(rng.integers(0, 1 + len(base) // 5))
        other = np.unique(np.concatenate((rng.permutation(base)[cut:], rng.integers(0, 1 << 64, new, dtype=np.uint64))))
        same = len(np.intersect1d(base, other))
        if len(other) < 3 or np.array_equal(base, other) or 100 * same < 75 * (len(base) + len(other) - same):
            continue
        shared = np.intersect1d(*(jaccard_join.signatures_of([x])[0] for x in (base, other)))
        assert len(shared) >= 1 + jaccard_join.slack(min(len(base), len(other)))


def element(band, part, cell, k):
    """The k-th hash that a band deals to this second-level partition."""
    cells = 3 * ((1 << band) // 2 + 24)
    return (-(-((3 * part + cell) << 32) // cells) + k << 32) + 12345


def least_shared(pairs):
    """Pairs of similar sets that share fewer signatures than they should."""
    sets = [np.array(sorted(x), dtype=np.uint64) for pair in pairs for x in pair]
    sigs, owner = jaccard_join.signatures_of(sets)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(sets) + 1))
    own = [set(sigs[order[a:b]].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]
    return [pair for k, pair in enumerate(pairs) if len(own[2 * k] & own[2 * k + 1]) < 1 + jaccard_join.slack(min(map(len, pair)))]


@pytest.mark.parametrize("n", [3, 4, 5, 6, 7, 8])
def test_signatures_for_all_placements(n):
    """n elements and one more, or one less in common, wherever they are: a partition is told by which of its parts are filled, so two partitions with three parts each and the rest apart cover all."""
    band = (n + 1).bit_length() - 1
    spots = [(p, c) for p in range(2) for c in range(3)] + [(p, 0) for p in range(2, 2 + max(0, n - 4))]
    pairs = []
    for where in itertools.combinations_with_replacement(range(len(spots)), n):
        common = {element(band, *spots[at], k) for k, at in enumerate(where)}
        for p, c in spots[:6]:
            pairs.append((common, common | {element(band, p, c, 900)}))
    assert least_shared(pairs) == []


def test_a_partition_with_differences():
    """All ways to fill a partition's three parts with common elements and such of one set, beside as few common ones as make the sets similar."""
    pairs = []
    for cells in itertools.product(itertools.product((0, 1, 2), (0, 1), (0, 1)), repeat=3):
        same, left, right = (sum(c[k] for c in cells) for k in range(3))
        need = max(0, -(-(75 * (left + right)) // 25) - same)  # same elements at least three times those of one
        for spread in (True, False):
            size = same + need + max(left, right)
            band = size.bit_length() - 1
            if min(left, right) + same + need < 3:
                continue
            a = {element(band, 0, c, k) for c, x in enumerate(cells) for k in range(x[0])} | {element(band, 1 + k if spread else 1, k % 3, k) for k in range(need)}
            b = a | {element(band, 0, c, 500) for c, x in enumerate(cells) if x[2]}
            a = a | {element(band, 0, c, 600) for c, x in enumerate(cells) if x[1]}
            pairs.append((a, b))
    assert least_shared(pairs) == []


@pytest.mark.parametrize("seed", [1, 2, 3, 5, 7])
def test_families_with_a_common_opening(spark, seed):
    """Small and middling sets, most of which is their family's, with copies of one word replaced or added."""
    rng = random.Random(seed)
    rows = []
    for family in range(8):
        n = rng.choice((6, 12, 30, 60))
        opening = [f"c{family}_{k}" for k in range(n)]
        for k in range(50):
            tail = [f"x{family}_{k}_{i}" for i in range(rng.randint(1, max(1, n // 3)))]
            text = opening + tail if rng.random() < 0.5 else tail + opening
            rows.append((len(rows), " ".join(text)))
            for _ in range(rng.randint(0, 2)):
                copy = list(text)
                if rng.random() < 0.5:
                    copy[rng.randrange(len(copy))] = f"y{len(rows)}"
                else:
                    copy.append(f"y{len(rows)}")
                rows.append((len(rows), " ".join(copy)))
    check(spark, rows)


def test_ids_with_several_texts(spark):
    """Near copies are grouped by text: of one id, texts that are none stay."""
    text = "the quick brown fox jumps over it all"
    rows = [(1, text), (1, text), (1, "quite another text that nobody else has here"), (2, text + " now"), (3, None), (3, ""), (3, ""), (None, text + " now"), (None, "of nobody at all but with words enough")]
    docs = frame(spark, [(*r, 5) for r in rows], "doc_id long, text string, row int")
    got = sorted(((r["doc_id"] or 0), r["text"] or "") for r in jaccard_join.first_of_groups(docs).collect())
    assert got == sorted([(0, rows[8][1]), (1, text), (1, rows[2][1]), (3, ""), (3, ""), (3, "")])
    assert jaccard_join.first_of_groups(docs).columns == docs.columns


def test_signatures_shared_by_many(spark):
    """One signature of thousands of sets takes the hot way and hides no link; buckets are many and small."""
    rng = random.Random(9)
    opening = "one common opening of all"
    rows = [(k, f"{opening} {' '.join(rng.choices('abcdefghij', k=rng.randint(3, 9)))}") for k in range(150)]
    check(spark, rows, hot=3, bucket=50)
    many = [(k, f"{opening} x{k} y{k} z{k}") for k in range(20_000)] + [(20_000, f"{opening} x7 y7 z7 end")]
    found = jaccard_join.near_duplicates(frame(spark, many, "doc_id long, text string"))
    assert found.where("component_id <> doc_id").count() == 1 and found.where("doc_id = 20000").first()["component_id"] == 7


def test_odd_rows(spark):
    """Repeated rows, ids without a value, a very long text, and columns named as inner ones."""
    text = "the quick brown fox jumps over it all"
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, text), (1, text), (2, text + " now"), (None, text), (None, "nobody else has this text here"), (3, long), (4, long + " end"), (5, "w" * 300_000)]
    docs = frame(spark, [(*r, "x", 1, 2) for r in rows], "doc_id long, text string, node string, low long, component_id long")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]


def test_components_in_parts(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(400)] + [(rng.randrange(1000, 3000), rng.randrange(1000, 3000)) for _ in range(900)] + [(5000, k) for k in range(5001, 5300)] + [(None, 4), (7, 7)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    for most in (100_000, 60):
        got = components(frame(spark, links, "u long, v long"), most).collect()
        assert len(got) == len(root) and dict(map(tuple, got)) == {x: find(x) for x in root}


def test_empty_table(spark):
    assert jaccard_join.near_duplicates(frame(spark, [], "doc_id long, text string")).count() == 0
