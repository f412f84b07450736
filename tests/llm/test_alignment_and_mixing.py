"""Whitening, curriculum and token alignment against brute force."""

import bisect
import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from codeterra.llm import alignment, curriculum, packing, whitening
from tests.conftest import frame

VECTORS = "vec_id long, embedding array<float>, label int"


def whitened(spark, rows, schema=VECTORS, **options):
    return whitening.whiten(frame(spark, rows, schema), **options).collect()


def integers_of(vectors):
    return [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]


def test_whitening_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5])).round(3).tolist()
    rows = [(k, v, 0) for k, v in enumerate(vectors)]
    rows += [(900, None, 0), (901, [1.0, None] + [0.0] * 4, 0), (902, [float("nan")] * 6, 0), (903, [float("inf")] + [0.0] * 5, 0), (904, [1e30] * 6, 0), (905, [], 0), (906, [1.0], 0), (5, vectors[5], 1), (None, vectors[7], 1)]
    found = whitened(spark, rows)
    kept = vectors + [vectors[5], vectors[7]]
    x, n = integers_of(kept), len(kept)
    sums = [sum(c) for c in zip(*x)]
    exact = [[Fraction(sum((r[i] * n - sums[i]) * (r[j] * n - sums[j]) for r in x), n**3) for j in range(6)] for i in range(6)]
    values, components = np.linalg.eigh(np.array([[float(v) for v in row] for row in exact]))
    assert len(found) == n * 6 and {r["n"] for r in found} == {n}
    by = {(r["vec_id"], r["component"]): r for r in found}
    for k in (0, 5, 299):
        assert by[k, 1]["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x[k], sums))
        for c in range(6):
            want = sum((a - s / n) * b for a, s, b in zip(x[k], sums, components[:, 5 - c])) / math.sqrt(values[5 - c])
            assert abs(abs(by[k, c + 1]["whitened"]) - abs(want)) < 1e-9
            assert by[k, c + 1]["explained"] == pytest.approx(values[5 - c] / values.sum(), rel=1e-9)
    assert max(r["identity_error"] for r in found) < 1e-9 and sum(r["vec_id"] == 5 for r in found) == 12 and sum(r["vec_id"] is None for r in found) == 6


def test_an_offset_common_to_all_rows_cancels(spark):
    """Variance of one unit beside entries of 10 ** 15, far below what doubles could tell of their squares."""
    rows = [(k, [2.0**40 + 2.0**17 * (k % 2), float(k % 3)], 0) for k in range(60)]
    found = {(r["vec_id"], r["component"]): r for r in whitened(spark, rows, "vec_id long, embedding array<double>, label int")}
    assert found[0, 1]["whitened"] * found[1, 1]["whitened"] == pytest.approx(-1) and found[0, 1]["identity_error"] < 1e-6
    x = [2**50 + 2**27 * (k % 2) + 100000 for k in range(60)], [1024 * (k % 3) + 100000 for k in range(60)]
    assert found[3, 2]["deviation"] == sum((60 * c[3] - sum(c)) ** 2 for c in x)
    assert abs(found[0, 1]["whitened"]) == pytest.approx(1, rel=1e-6)


def test_whitening_without_variance(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, [1.0, 2.0], 0)]) == [] and whitened(spark, [(k, [3.0], 0) for k in range(5)]) == []
    assert {r["component"] for r in whitened(spark, [(k, [float(k), 1.0, 2.0 * k], 0) for k in range(9)])} == {1}


def test_residues_give_back_integers():
    rng = random.Random(4)
    for bits in (10, 60, 200):
        moduli = whitening.primes(bits + 1)
        values = [rng.randrange(-(2 ** (bits - 1)), 2 ** (bits - 1)) for _ in range(50)]
        assert whitening.remainder([[v % p for v in values] for p in moduli], moduli) == values


PLAN = curriculum.cycled((3.0, 1.0, 2.0), (curriculum.STEADY, ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.0), (0.5, 0.0), (1.0, 1.0))))
DOCS = "doc_id long, text string, source string, lang string"


def mixed(rows, share=1.5, most=2.0):
    """doc rows -> per row (doc_id, size, source_size, target, taken), by resharing until none is above."""
    size = lambda t: len((t or "").encode().split())
    sources = sorted({r[2] for r in rows if r[2] is not None}) + ([None] if any(r[2] is None for r in rows) else [])
    total = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sources)}
    target, left, open_ = {}, share * sum(total.values()), set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > most * total[s]}
        if not above:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: most * total[s] for s in above}
        left -= sum(most * total[s] for s in above)
        open_ -= above
    out = []
    for s in sources:
        own = sorted((hashlib.md5((str(r[0]) if r[0] is not None else "").encode()).hexdigest(), size(r[1]), k, r[0]) for k, r in enumerate(rows) if r[2] == s)
        before = 0
        for _, n, _, doc in own:
            taken = sum(max(0, min(n, math.floor(target[s]) - before - p * total[s])) for p in range(2))
            out.append((doc, n, total[s], round(target[s], 6), taken))
            before += n
    return sorted(out, key=str)


def test_mix_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, "w " * rng.choice((0, 1, 5, 40, 300)), f"s{min(rng.randrange(12), rng.randrange(12))}", "en") for k in range(300)]
    rows += [(k, "hot " * 3, "s1", None) for k in range(300, 500)] + [(7, "again and again", "s1", "x")] * 40 + [(7, "another", "s2", "x"), (None, "no id", None, None), (501, None, None, "x"), (502, " \t\x0b\n ", "é", "x"), (503, "é è", "z", "x")]
    found = curriculum.assign(frame(spark, [(*r, 1) for r in rows], f"{DOCS}, size int"), PLAN).collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in found), key=str) == mixed(rows)
    assert all(r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0) for r in found)


def test_positions_follow_the_schedules(spark):
    """The part of a source that is due by any progress is its schedule's integral up to there, to within a document."""
    docs = frame(spark, [(k, "one two three", f"s{k % 3}", "en") for k in range(3000)], DOCS)
    order = curriculum.curriculum(docs, PLAN, keep=("text", "lang")).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order) and order[0]["text"] == "one two three"
    taken = Counter()
    due = {"s0": lambda t: t, "s1": lambda t: (0.5 * t + t * t / 2), "s2": lambda t: max(0.0, 2 * t - 1) ** 2}
    whole = {s: sum(r["words"] for r in order if r["source"] == s) for s in due}
    assert whole == {"s0": 6000, "s1": 2500, "s2": 5000}  # of 13,500 the first stops at twice its 3,000
    for r in order:
        assert abs(taken[r["source"]] / whole[r["source"]] - due[r["source"]](r["position"])) < 0.002
        taken[r["source"]] += r["words"]
    again = curriculum.curriculum(docs.repartition(7), PLAN, keep=("text",)).collect()
    assert sorted((r["doc_id"], r["pass"], r["words"], r["position"]) for r in again) == sorted((r["doc_id"], r["pass"], r["words"], r["position"]) for r in order)


def test_mix_of_nothing(spark):
    assert curriculum.assign(frame(spark, [], DOCS), PLAN).count() == 0
    assert [tuple(r) for r in curriculum.assign(frame(spark, [(1, "", "a", ""), (2, None, None, "")], DOCS), PLAN).select("doc_id", "target", "taken").orderBy("doc_id").collect()] == [(1, 0.0, 0), (2, 0.0, 0)]


def test_many_sources(spark):
    """Each with one document; ranks, targets and sums go by the same rules."""
    rows = [(k, "w " * (1 + k % 7), f"s{k:04d}", "en") for k in range(700)]
    found = curriculum.assign(frame(spark, rows, DOCS), PLAN).collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in found), key=str) == mixed(rows)


def paths():
    return packing.tokenizer_path(alignment.FIRST), packing.tokenizer_path(alignment.SECOND)


def by_hand(rows):
    """Every result by the plain libraries and loops over byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(paths()[0]), sentencepiece.SentencePieceProcessor(model_file=paths()[1])
    first.encode_special_tokens = True
    letters, entries = packing._byte_letters(), {v: k for k, v in first.get_vocab().items()}
    a_bytes = lambda i: bytes(letters[c] for c in entries[i])
    b_bytes = lambda i: bytes([int(p[3:5], 16)]) if (p := second.id_to_piece(i)).startswith("<0x") else p.replace("▁", " ").encode()

    def spans(ids, size):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(size(i)), i))
            at = out[-1][1]
        return out

    count, found = Counter(), []
    for doc, text, *_ in rows:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        want = f" {text}".encode()
        if not text or b"".join(map(a_bytes, a)) != want or b"".join(map(b_bytes, b)) != want:
            found.append((doc, [], [], [], []))
            continue
        a, b = spans(a, a_bytes), spans(b, b_bytes)
        cuts = sorted({x[1] for x in a} & {x[1] for x in b})
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        count.update(links)
        found.append((doc, a, b, cuts, links))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for doc, a, b, cuts, links in found:
        groups = [([], []) for _ in cuts]
        for side, tokens in enumerate((a, b)):
            for _, end, i in tokens:
                groups[bisect.bisect_left(cuts, end)][side].append(str(i))
        text = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        out.append((doc, len(a), len(b), len(cuts), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def test_alignment_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    words = "the of and naïve café résumé 日本語 привет 12345 don't  <|endoftext|> <s> </s> \t\n\n   🙂 x" .split(" ")
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    texts += [None, "", " ", "  ", "\n", "a▁b", "<0x41>", "\x00", "z" * 3000, "é", "　wide", "the same", "the same"]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(3, "a second text of one id", "x"), (None, "the same", "x")]
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 200)
    docs = frame(spark, rows, "doc_id long, text string, block string")
    want = by_hand(rows)
    for parts in (1, 5):
        assert sorted(map(tuple, alignment.align(docs.repartition(parts), *paths()).collect()), key=str) == want
    links = {(r["first_id"], r["second_id"]): r["count"] for r in alignment.links(docs, *paths()).collect()}
    assert sum(links.values()) == sum(r[4] for r in want)


def test_long_texts_in_parts(monkeypatch):
    """A cut before a blank after a letter changes no token."""
    both = alignment.pair(*paths())
    rng = random.Random(8)
    text = "".join(rng.choices(["word", " ", "  ", "\n", "ß", "🙂", "   a", " the"], k=4000))
    whole = both.second.encode(text)
    monkeypatch.setattr(alignment, "PART", 50)
    parts = both._parts(text)
    assert len(parts) > 50 and [i for p in parts for i in both.second.encode(p)] == whole


def test_alignment_of_nothing(spark):
    assert alignment.align(frame(spark, [], "doc_id long, text string"), *paths()).count() == 0
    assert [tuple(r) for r in alignment.align(frame(spark, [(1, None)], "doc_id long, text string"), *paths()).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
