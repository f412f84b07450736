"""The text operators against brute force, on small tables with nulls, ties, repeats, clashing columns and odd texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codeterra.llm import decontaminate, license_scan, merkle, packing, quality_rules, secret_scan, substring_dedup, toxicity, url_filter
from tests.conftest import frame

SCHEMA = "doc_id long, text string, source string"


def rows(seed=3, n=40):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Über", "çé", "token", "="]
    made = [(k, " ".join(rng.choices(words, k=rng.randint(0, 120))), f"s{k % 3}") for k in range(n)]
    shared = " ".join(f"q{k}" for k in range(70))
    made += [(n + k, f"head{k} {shared} tail{k}", None) for k in range(4)]
    return [*made, (n + 10, None, "s1"), (n + 11, "", None), (n + 12, made[1][1], "s1"), (n + 13, "x" * 5000, "s2")]


def tree(text):
    """[(section, [(paragraph, [leaf])])] of digests, cut where the operator cuts, hashed from the leaves up apart from its code."""
    h = lambda parts, level: hashlib.blake2b(b"".join(parts), digest_size=16, person=level).digest()
    out, now = [], []
    for leaves in merkle._paragraphs(text.encode()):
        own = [h([x], b"leaf") for x in leaves]
        now.append((h(own, b"paragraph"), own))
        if leaves == [b"\n"] or now[-1][0][0] % 4 == 0:
            out.append((h([p for p, _ in now], b"section"), now))
            now = []
    return [*out, (h([p for p, _ in now], b"section"), now)] if now else out


def tree_line(text):
    t = tree(text)
    root = hashlib.blake2b(b"".join(x for x, _ in t), digest_size=16, person=b"root").hexdigest()
    return root + ":" + ";".join(",".join([x.hex()[:12], *(p.hex()[:12] + "".join(leaf.hex()[:8] for leaf in leaves) for p, leaves in ps)]) for x, ps in t)


def leaf_share(a, b):
    x, y = (Counter(leaf for _, ps in tree(t) for _, leaves in ps for leaf in leaves) for t in (a, b))
    return 1.0 if a == b else 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())) if x and y else 0.0


def lacking(a, b):
    """Branches of a whose section b has not (as often), and of these whose paragraph the rest of b has not."""
    left, right = tree(a), tree(b)
    free_sections = Counter(x for x, _ in right)
    mine = []
    for i, (x, ps) in enumerate(left):
        free_sections[x] -= 1
        if free_sections[x] < 0:
            mine += [(i, j, p) for j, (p, _) in enumerate(ps)]
    used = Counter(x for x, _ in left)
    rest = Counter()
    for x, ps in right:
        used[x] -= 1
        if used[x] < 0:
            rest.update(p for p, _ in ps)
    out = []
    for i, j, p in mine:
        rest[p] -= 1
        if rest[p] < 0:
            out.append(f"{i}.{j}")
    return ",".join(out)


def test_merkle_meets_the_next_document(spark):
    data = rows()
    texts = {d: t or "" for d, t, _ in data}
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in merkle.edit_likeness(frame(spark, data, SCHEMA)).collect()}
    for d, after in zip(order, order[1:] + order[:1]):
        own, following = texts[d], texts[after]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(own)
        assert got[d]["fingerprint"] == tree_line(own) and got[d]["edited_fingerprint"] == tree_line(edited)
        assert abs(got[d]["near_next"] - leaf_share(own, following)) < 1e-9 and abs(got[d]["near_edited"] - leaf_share(own, edited)) < 1e-9
        assert got[d]["changed"] == ("" if edited == own else lacking(edited, own))
    single = merkle.edit_likeness(frame(spark, [(5, "abcd ef", "s"), (None, "gh", "s")], SCHEMA)).collect()
    assert {(r["doc_id"], r["near_next"]) for r in single} == {(5, 1.0), (None, None)}
    assert merkle.edit_likeness(frame(spark, [], SCHEMA)).count() == 0
    twice = merkle.edit_likeness(frame(spark, [(1, "a b.\nc", "s"), (1, "a b.\nc", "s"), (2, "x " * 50_000, "s")], SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in twice) == [1, 1, 2]


def test_merkle_locates_edits():
    text = "".join(f"Line {k} of this text stands here.\n" for k in range(30))
    a, b = merkle.Fingerprint.of(text), merkle.Fingerprint.of(text.replace("Line 17 of", "Line 17 from"))
    changed = merkle.differences(a, b)
    assert len(changed) == 1 and 0.9 < merkle.likeness(a, b) < 1
    assert str(merkle.Fingerprint.parse(str(a))) == str(a) and merkle.differences(a, a) == []


def spans(text):
    found = []
    kinds = ((r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24))
    for rank, (pattern, group, least) in enumerate(kinds):
        found += [(m.start(), rank, ("assign", "access", "hex")[rank], m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return sorted(found)


def test_secrets(spark):
    key = "AKIA" + "B" * 17
    texts = ["é token=token: abcdefgh", f"API_KEY = '{key}' and {key}", "a1" * 20 + " secret:abc password=\"0123456789abcdef0123456789\"", "ſecret=abcdefgh Passwd==xyzabc", None, "", "none", "none"]
    data = [(k, t, "s") for k, t in enumerate(texts)]
    docs = frame(spark, data, SCHEMA).withColumn("spans", F.lit(1))
    ledger = secret_scan.scan(docs)
    assert ledger.count() == 6
    for r in secret_scan.findings(docs, ledger).withColumn("clean", secret_scan.redact(F.col("text"), F.col("spans"))).collect():
        want = spans(r["text"] or "")
        assert [tuple(x) for x in r["spans"]] == want
        clean, at = "", -1
        for start, _, _, end in want:
            if start > at:
                clean += (r["text"] or "")[max(at, 0) : start] + secret_scan.MARK
            at = max(at, end)
        assert r["clean"] == (r["text"] if not want else clean + r["text"][at:])
    assert secret_scan.scan(docs.limit(0)).count() == 0 and secret_scan.findings(docs.limit(0), ledger).count() == 0
    odd = docs.withColumn("blob", F.lit(1)).withColumn("found", F.lit(2)).withColumn("__blob", F.lit(3))
    assert secret_scan.findings(odd.union(odd), ledger).where("blob = 1 and found = 2 and __blob = 3").count() == 16
    long = frame(spark, [(1, "secret=abcdefgh " * 5_000, "s")], SCHEMA)
    assert secret_scan.findings(long, secret_scan.scan(long)).select(F.size("spans")).first()[0] == 5_000
    # the ledger makes a second scan take only what is new
    assert secret_scan.scan(docs.union(docs), ledger).count() == 0
    newer = (*secret_scan.RULES, secret_scan.Rule("pem", 1, "-----BEGIN"))
    assert {tuple(r["rules"]) for r in secret_scan.scan(docs, ledger, newer).collect()} == {("pem:1",)}


def test_urls(spark):
    urls = ["http://A.net/x", "https://www.example.net/en/1?q=://z", "http://example.net/en", "http://notexample.com/de/", "x://b.example.com/de/#a", "http://org/fr/", "ftp:/bad", None, "http://net", "http:///path", "http://a.org/fr/", "http://a.org/fr"]
    pages = frame(spark, list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("own"))
    got = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.rules_table(spark)).collect()}
    for k, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path, host = re.match("[^?#]*", rest[len(host) :])[0], host.lower()
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (host, path, *(max(fit)[1:] if fit else (None, "allow")))
    odd = pages.withColumn("best", F.lit("own")).withColumn("best_", F.lit("own")).withColumn("a b.c", F.lit(1))
    again = url_filter.judge(odd.union(odd), url_filter.rules_table(spark))
    assert again.count() == 2 * len(urls) and again.where("best = 'own' and verdict = 'block'").count() == 2 * sum(r["verdict"] == "block" for r in got.values())
    assert url_filter.judge(odd.limit(0), url_filter.rules_table(spark)).count() == 0
    bare = url_filter.judge(pages, url_filter.rules_table(spark).limit(0))
    assert bare.where("rule is null and verdict = 'allow'").count() == len(urls)
    many = frame(spark, [("block", f"h{k}.example", f"/{'p' * (k % 7)}") for k in range(3000)], "verdict string, host string, path string")
    hits = url_filter.judge(frame(spark, [(k, f"http://a.h{k}.example/{'p' * 9}") for k in range(4000)], "page_id long, url string"), many)
    assert hits.where("verdict = 'block'").count() == 3000


def test_windows_of_a_benchmark(spark):
    words = [f"b{k}" for k in range(40)]
    items = [("1", " ".join(words[:25])), ("2", "short item"), ("3", None), ("2", "short item")]
    texts = ["x " + " ".join(words[3:20]).upper() + " y", "a Short, item! b", " ".join(words[:9]), None, ""]
    found = decontaminate.flagged(frame(spark, [(k, t, "s") for k, t in enumerate(texts)], SCHEMA).withColumn("n_hit", F.lit(9)), frame(spark, items, "item_id string, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()}
    assert got == {0: (19, 17, ["1"]), 1: (4, 2, ["2"]), 2: (9, 0, []), 3: (0, 0, []), 4: (0, 0, [])}


def test_a_benchmark_of_many_blocks(spark, monkeypatch):
    """Blocks one after the other give what one gives; an item without an id hits and is not listed."""
    rng = random.Random(6)
    items = [(str(k), " ".join(rng.choices("abcdefgh", k=rng.randint(1, 14)))) for k in range(60)] + [(None, "zebra yak")]
    docs = frame(spark, [(k, " ".join(rng.choices("abcdefgh", k=400)), "s") for k in range(12)] + [(20, "one zebra yak", "s"), (20, "one zebra yak", "s"), (None, "q " * 40_000, "s")], SCHEMA).withColumn("name", F.lit("own"))
    bench = frame(spark, items, "item_id string, text string")
    columns = ["doc_id", "source", "name", "n_words", "n_hit", "item_ids"]
    one = sorted(map(str, decontaminate.flagged(docs, bench).select(columns).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    assert sorted(map(str, decontaminate.flagged(docs, bench).select(columns).collect())) == one
    assert sum("'name'" in x or "own" in x for x in one) == 15 and sum("n_hit=2, item_ids=[]" in x for x in one) == 2
    assert decontaminate.flagged(docs, bench.limit(0)).where("n_hit > 0").count() == 0 and decontaminate.flagged(docs.limit(0), bench).count() == 0


def test_packing_is_a_round_trip(spark):
    data = rows()
    path = packing.tokenizer_path()
    pieces = packing.pack(frame(spark, data, SCHEMA), path, with_ids=True).toPandas()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    for d, text, _ in data:
        own = pieces[pieces.doc_id == d].sort_values("start")
        ids = np.concatenate([np.frombuffer(x, dtype="<u4") for x in own.ids])
        assert ids.tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert own.start.tolist() == np.concatenate(([0], np.cumsum(own.length)[:-1])).tolist()
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == np.concatenate(([0], np.cumsum(own.length)[:-1])).tolist() and own.length.sum() <= packing.LENGTH
    sizes = pieces.groupby("sequence_id").length.sum().sort_index()
    assert (sizes.iloc[:-1] == packing.LENGTH).all()


def round_robin(queues, quanta, length):
    """Deficit round-robin, one round after the other: the source of each token of the stream, with its place in its queue."""
    at, deficit, stream = dict.fromkeys(queues, 0), dict.fromkeys(queues, 0), []
    while any(at[q] < n for q, n in queues.items()):
        for q in sorted(queues):
            deficit[q] += quanta[q]
            many = min(deficit[q] >> packing.FRACTION, queues[q] - at[q])
            deficit[q] -= (deficit[q] >> packing.FRACTION) << packing.FRACTION
            stream += [(q, at[q] + k) for k in range(many)]
            at[q] += many
    return stream


def test_packing_is_a_deficit_round_robin(spark):
    """The stream of three sources over several partitions is the one that rounds served one by one give, at given and own shares."""
    data = [(k, text, f"s{k % 3}") for k, (_, text, _) in enumerate(rows(n=60))]
    docs, path, length = frame(spark, data, SCHEMA).repartition(5), packing.tokenizer_path(), 64
    for shares in (None, {"s0": 0.6, "s1": 0.3, "s2": 0.1}):
        pieces = packing.pack(docs, path, length=length, shares=shares).toPandas()
        pieces["at"] = pieces.sequence_id * length + pieces.offset
        pieces = pieces.sort_values("at")
        totals = pieces.groupby("source").length.sum().to_dict()
        want = shares or totals
        quanta = {q: max(1, round(want[q] / sum(want.values()) * (length << packing.FRACTION))) for q in totals}
        stream = round_robin(totals, quanta, length)
        got = [q for q, n in zip(pieces.source, pieces.length) for _ in range(n)]
        assert got == [q for q, _ in stream]
        if shares:  # while all queues have tokens, every window holds its target to within a token of each source
            for k in range(min(int(totals[q] / want[q]) for q in totals) // length - 1):
                window = Counter(got[k * length : (k + 1) * length])
                assert all(abs(window[q] - share * length) <= 2 for q, share in shares.items())


def test_packing_odd_rows(spark):
    path = packing.tokenizer_path()
    docs = frame(spark, [(1, "a b", 7), (1, "a b", 7), (None, None, None), (2, "", 8)], "doc_id long, text string, source int").withColumn("queue", F.lit("x")).withColumn("ids", F.lit(1))
    pieces = packing.pack(docs, path).toPandas()
    assert sorted(pieces.source) == ["", "7", "7", "8"] and sorted(pieces.doc_tokens.tolist()) == [1, 1, 3, 3] and len(packing.pack(docs.limit(0), path).collect()) == 0


def test_packing_keeps_a_queue_for_each_of_many_sources(spark, monkeypatch):
    data = [(k, text, source if k % 5 else f"own{k}") for k, text, source in rows()]
    docs, path = frame(spark, data, SCHEMA), packing.tokenizer_path()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    sources = sorted({source or "" for _, _, source in data})
    for shares in (None, {source: 1.0 + k for k, source in enumerate(sources)}):
        monkeypatch.setattr(packing, "MAX_QUEUES", 4096)
        few = packing.pack(docs, path, length=64, shares=shares).select(columns).collect()
        monkeypatch.setattr(packing, "MAX_QUEUES", 2)
        many = packing.pack(docs, path, length=64, shares=shares).select(columns).collect()
        assert sorted({r["source"] for r in many}) == sources
        assert sorted(map(tuple, many)) == sorted(map(tuple, few))


def test_repeated_windows_are_removed(spark):
    data = rows()
    words = {d: (t or "").split() for d, t, _ in data}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    for r in substring_dedup.dedup(frame(spark, data, SCHEMA)).collect():
        own, d = words[r["doc_id"]], r["doc_id"]
        gone = {k for i in range(len(own) - 49) if first[tuple(own[i : i + 50])] < d for k in range(i, i + 50)}
        assert r["kept"] == " ".join(w for k, w in enumerate(own) if k not in gone) and r["n_removed"] == len(gone)


def test_hot_anchors_are_settled_by_windows(spark):
    """One passage in many surroundings has more passages than a shard takes; results stay those of brute force."""
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(64)]
    data = [(k, " ".join([*rng.choices("abcdefgh", k=30), *passage[: rng.randint(50, 64)], *rng.choices("abcdefgh", k=30)]), "s") for k in range(30)]
    data += [(40, None, "s"), (41, "a", "s")]
    docs = frame(spark, data, SCHEMA).withColumn("anchor", F.lit(1))
    first: dict[tuple, int] = {}
    words = {d: (t or "").split() for d, t, _ in data}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    want = {d: {k for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for k in range(i, i + 50)} for d, w in words.items()}
    for shard in (2, 4000):
        got = {r["doc_id"]: {k for x in r["spans"] for k in range(x["start"], x["end"])} for r in substring_dedup.repeated_spans(docs, shard=shard).collect()}
        assert got == {d: gone for d, gone in want.items() if gone}
    assert substring_dedup.dedup(docs.limit(0)).count() == 0
    odd = substring_dedup.dedup(frame(spark, [(None, " ".join(passage), "s"), (3, " ".join(passage), "s"), (3, " ".join(passage), "s")], SCHEMA)).collect()
    assert sorted(r["n_removed"] for r in odd) == [0, 0, 0]


def test_ids_with_several_texts_keep_their_own_spans(spark):
    """Windows of a smaller id go from each of an id's texts, at that text's places; what only texts of one id share stays."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    data = [(1, a, "s"), (2, f"{b} {a}", "s"), (2, f"zz {b}", "s"), (2, f"zz {b}", "s"), (3, f"{b} end", "s")]
    for parts in (1, 3, 8):
        for shard in (1, 4000):
            docs = frame(spark, data, SCHEMA).repartition(parts)
            spans = {(r["doc_id"], r["row"]): r["spans"] for r in substring_dedup.repeated_spans(docs, shard=shard).collect()}
            assert len(spans) == 2
        got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(docs).collect())
        assert got == [(1, 60, 0), (2, 61, 0), (2, 61, 0), (2, 120, 60), (3, 61, 60)]


WRAPPED_GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
WRAPPED_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the Software), to deal
in the Software without restriction, including without limitation the rights"""
WRAPPED_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""


def test_wrapped_notices_and_recall(spark):
    """Every planted notice, whole or wrapped, is found and confirmed; prose has none. Planted rows are not among those learned from."""
    rng = random.Random(12)
    prose = lambda: " ".join(rng.choices("the river is wide under a bridge and software runs free of charge in this public library with terms".split(), k=rng.randint(5, 60)))
    planted = [("gpl", WRAPPED_GPL), ("mit", WRAPPED_MIT), ("bsd", WRAPPED_BSD)] + [(family, t) for family, ts in license_scan.TEMPLATES.items() for t in ts]
    data = [(k, f"{prose()}\n\n{text}\n\n{prose()}", family) for k, (family, text) in enumerate(planted)]
    clean = [(1000 + k, "\n".join(prose() for _ in range(rng.randint(1, 6))), None) for k in range(150)]
    model = license_scan.train(frame(spark, [(k, t, "s") for k, t, _ in clean[:75]], SCHEMA))
    got = {r["doc_id"]: r for r in license_scan.classify(frame(spark, [(k, t, "s") for k, t, _ in data + clean], SCHEMA), model).collect()}
    right = [family in got[k]["licenses"] for k, _, family in data]
    assert sum(right) >= 0.95 * len(right) and all(right[:3])
    assert sum(got[k]["license"] is not None for k, _, _ in clean) <= 3 and not any(got[k]["licenses"] for k, _, _ in clean)


def test_licenses_odd_rows(spark):
    docs = frame(spark, [(1, "Licensed under the MIT License.", "s")] * 2 + [(None, None, None), (2, "x" * 200_000, "s")], SCHEMA).withColumn("lines", F.lit(1)).withColumn("best", F.lit(2)).withColumn("some", F.lit(3))
    assert sorted((r["doc_id"] or 0, r["license"] or "") for r in license_scan.licenses(docs).collect()) == [(0, ""), (1, "mit"), (1, "mit"), (2, "")]
    assert license_scan.licenses(docs.limit(0)).count() == 0


def test_licenses(spark):
    texts = ["Prose.\nReleased under the MIT License.\nMore.", "You need a license to drive.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", None, "", "the river is under the mountain", "x\n" * 300 + "LICENSED under the Apache License, Version 2.0."]
    docs = frame(spark, [(k, t, "s") for k, t in enumerate(texts)], SCHEMA)
    model = license_scan.train(docs)
    got = {r["doc_id"]: r for r in license_scan.classify(docs, model).collect()}
    assert {k: r["license"] for k, r in got.items()} == {0: "mit", 1: None, 2: "cc-by-nc", 3: "proprietary", 4: None, 5: None, 6: None, 7: "apache"}
    for k, text in enumerate(texts):
        best = [p for line in (text or "").split("\n") for p in [model.probabilities(line)] if p.argmax() < len(p) - 1 and p.max() >= license_scan.LEAST]
        assert (got[k]["probability"] is None) == (not best)
        if best:
            assert abs(got[k]["probability"] - max(p.max() for p in best)) < 1e-9


def test_quality_rules_are_compiled_as_fitted(spark):
    rng = random.Random(4)
    good = [(k, " ".join(rng.choices(["the", "river", "is", "wide.", "and", "calm"], k=rng.randint(20, 80))), "s") for k in range(150)]
    bad = [(k, " ".join(f"{w}$$$" for w in rng.choices(["buy", "NOW", "a"], k=rng.randint(1, 60))), "s") for k in range(150, 300)]
    docs = frame(spark, [*good, *bad, (900, None, "s"), (901, "", "s"), (None, "a b", "s")], SCHEMA)
    labels = frame(spark, [(k, int(k < 150)) for k in range(300)] + [(901, None)], "doc_id long, quality int")
    model = quality_rules.train(docs, labels)
    assert 0 < len(model.rules) < 40
    shown = quality_rules.with_statistics(docs).withColumn("score", model.score()).toPandas()
    x = shown[[f"__s_{s}" for s in quality_rules.STATISTICS]].to_numpy(dtype=float)
    assert np.allclose(shown.score, model.scores(x))
    got = quality_rules.quality(docs, labels).toPandas()
    known = got[got.held_out & got.doc_id.notna() & (got.doc_id < 300)]
    assert len(got) == 303 and ((known.predicted == 1) == (known.doc_id < 150)).mean() > 0.95


def test_rules_and_lasso_by_hand():
    """Trees find the cut that parts the classes; the kept rules' weights meet the lasso's condition of a minimum."""
    rng = np.random.default_rng(3)
    x = rng.random((600, len(quality_rules.STATISTICS)))
    y = ((x[:, 2] > 0.6) & (x[:, 4] <= 0.5)).astype(float)
    rules = quality_rules.tree_rules(x, y)
    used = {s for rule in rules[:6] for s, _, _ in rule}
    assert {2, 4} & used and all(len(rule) <= quality_rules.DEPTH for rule in rules) and len(rules) == len(set(rules))
    for rule in rules[:20]:
        assert quality_rules._holds(rule, x).tolist() == [all((row[s] > limit) == greater for s, greater, limit in rule) for row in x]
    model = quality_rules.fit(x, y)
    p = model.scores(x)
    assert ((p > 0.5) == y).mean() > 0.97
    for rule, weight in model.rules:
        pull = (quality_rules._holds(rule, x) * (p - y)).mean()
        assert weight != 0 and abs(abs(pull) - quality_rules.PENALTY) < 0.002


def test_quality_odd_rows(spark):
    docs = frame(spark, [(5, "a b c", "s")] * 2 + [(None, None, None), (7, "w " * 100_000, "s")], SCHEMA).withColumn("score", F.lit("own")).withColumn("__t", F.lit(1)).withColumn("__s_n_words", F.lit(1))
    labels = frame(spark, [(5, 1), (5, 0), (7, None)], "doc_id long, quality int")
    assert quality_rules.quality(docs, labels).count() == 4 and quality_rules.quality(docs.limit(0), labels.limit(0)).count() == 0
    kept = quality_rules.with_statistics(docs)
    assert "__t" in kept.columns and kept.where("__t = 1").count() == 4


def sample(texts):
    """Texts as (index, rate) pairs in the trainer's flat form."""
    return toxicity.Sample(pa.table({"features": [np.array([i for i, _ in t], dtype=np.int32).tobytes() for t in texts], "rates": [np.array([r for _, r in t], dtype=np.float32).tobytes() for t in texts]}, schema=pa.schema([("features", pa.binary()), ("rates", pa.binary())])))


def test_risk_and_its_gradient():
    """The estimator by its formula, its gradient by finite differences, and the turn where the second part is negative."""
    rng = np.random.default_rng(2)
    make = lambda n: [[(i, rng.random()) for i in range(4) if rng.random() < 0.7] for _ in range(n)]
    p_texts, u_texts = [[(4, 1.0), *t] for t in make(9)], make(14)
    p, u = sample(p_texts), sample(u_texts)
    loss = lambda z: np.log1p(np.exp(-z))
    turned = set()
    for prior, own in ((0.2, 0.5), (0.9, -1.0), (0.9, 6.0)):
        w, b = np.append(rng.normal(size=4), own), 0.3
        margin = lambda texts, w, b: np.array([sum(np.float32(r) * w[i] for i, r in t) + b for t in texts])

        def parts(w, b):
            mp, mu = margin(p_texts, w, b), margin(u_texts, w, b)
            return prior * loss(mp).mean(), loss(-mu).mean() - prior * loss(-mp).mean()

        positive, negative, g = toxicity.risk(p, u, prior, w, b)
        assert np.allclose((positive, negative), parts(w, b))
        follow = (lambda w, b: sum(parts(w, b))) if negative >= 0 else (lambda w, b: -parts(w, b)[1])
        turned.add(bool(negative < 0))
        for k in range(6):
            step = np.zeros(6)
            step[k] = 1e-5
            slope = (follow(w + step[:5], b + step[5]) - follow(w - step[:5], b - step[5])) / 2e-5
            assert abs(slope - g[k]) < 1e-6
    assert turned == {False, True}


def test_toxicity_odd_rows(spark):
    docs = frame(spark, [(5, "vile words", "s")] * 3 + [(None, None, None), (7, "w " * 100_000, "s"), (8, "", "s")], SCHEMA).withColumn("score", F.lit("own")).withColumn("kind", F.lit(1))
    labels = frame(spark, [(5, 1), (5, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got) and [r["held_out"] for r in got if r["doc_id"] is None] == [True]


def test_toxicity_learns_from_positives(spark):
    rng = random.Random(5)
    plain = ["river", "stone", "wide", "and", "the", "calm", "field"]
    data = [(k, " ".join(rng.choices(plain + (["vile", "awful"] if k % 5 == 0 else []), k=40)), "s") for k in range(600)]
    docs = frame(spark, [*data, (900, None, "s"), (901, "", "s")], SCHEMA).withColumn("score", F.lit("own"))
    labels = frame(spark, [(k, int(k % 5 == 0)) for k in range(600)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).toPandas()
    known = got[got.held_out & (got.doc_id < 600)]
    assert len(got) == 602 and got.score.between(0, 1).all() and ((known.predicted == 1) == (known.doc_id % 5 == 0)).mean() > 0.95
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0
