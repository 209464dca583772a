"""Exact duplicates, filter audit and source audit against plain Python, with nulls, ties, repeats, clashing columns and no rows."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vantage.llm import exact_dedup, filter_audit, source_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content string, key string, `row` long, part string, n long, _salt int, total long"


def table(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns have the names that the operators use themselves."""
    return spark.createDataFrame([(*r, 7, "x", "x", 7, "x", 7, 7, 7) for r in rows], SCHEMA).repartition(5)


def some_rows(seed, n=160):
    draw = random.Random(seed)
    words = ["Tree", "lake", "stone", "wind", "ÉTÉ", "été", "ß", "x", "AB", "#", "日本"]
    rows = []
    for i in range(n):
        text = " ".join(draw.choices(words[: draw.randint(2, 11)], k=draw.choice([0, 1, 3, 40, 210, 260])))
        if draw.random() < 0.3 and rows:
            text = draw.choice(rows)[1]
            text = text and draw.choice([text, text.replace(" ", "\n "), text + " \t", text.replace(" ", "")])
        rows.append((draw.choice([i, i, i, None, draw.randint(0, n)]), draw.choice([text, text, text, text, None]), draw.choice(["en", "de", "de", None, ""]), draw.choice(["a", "b", None, "ü"])))
    return rows + [(n + 1, "word " * 60_000, "en", "a"), (n + 2, "hot text", "en", "a"), (n + 2, "hot text", "en", "a")] + [(n + 3 + i, "hot  text", "en", "a") for i in range(n // 2)]


def content(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_duplicates(spark, digest_chars):
    """With a digest of one character nearly all groups hold several contents, and only contents can part them."""
    rows = some_rows(1)
    got = exact_dedup.exact_duplicates(table(spark, rows), digest_chars=digest_chars).collect()
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[content(text)].append((-len(text or ""), i is None, i or 0, i))
    best = {c: min(g) for c, g in groups.items()}
    want = Counter((i, best[content(t)][3], len(groups[content(t)]), hashlib.sha256(content(t).encode()).hexdigest()) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [(r.text_sha256, r.doc_id) for r in got if r.kept]
    assert sorted(kept, key=str) == sorted(((hashlib.sha256(c.encode()).hexdigest(), b[3]) for c, b in best.items()), key=str)


def test_exact_duplicates_no_rows(spark):
    assert exact_dedup.exact_duplicates(table(spark, []), digest_chars=64).count() == 0
    assert [tuple(r) for r in exact_dedup.exact_duplicates(spark.createDataFrame([("a1", None)], "doc_id string, text string")).collect()] == [("a1", "a1", 1, True, hashlib.sha256(b"").hexdigest())]


def failures(rows):
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text]}
        yield {x for x, b in bad.items() if b}


def test_filter_audit(spark):
    rows, draw = some_rows(2), random.Random(3)
    marks = [(draw.choice([i, None, i + 1]), draw.choice([0, 1, None]), draw.choice([0, 1, None]), "x") for i in range(0, 200, 2)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, good string")
    good, toxic = {i for i, q, *_ in marks if q == 1 and i is not None}, {i for i, _, t, _ in marks if t == 1 and i is not None}
    told = [(r[0], r[2] or "", f) for r, f in zip(rows, failures(rows), strict=True)]
    want, shapley = {}, Counter()
    for part in {p for _, p, _ in told}:
        mine = [(i, f) for i, p, f in told if p == part]
        for order in itertools.permutations("ABCDE"):
            alive = mine
            for step, x in enumerate(order, 1):
                removed, alive = [(i, f) for i, f in alive if x in f], [(i, f) for i, f in alive if x not in f]
                shapley[part, x] += len(removed)
                want[part, "".join(order), step] = (
                    len(alive), len(removed), sum(x in f for _, f in mine) - len(removed), sum(f == {x} for _, f in mine), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)
                )
    got = filter_audit.audit_filters(table(spark, rows), labels).collect()
    assert len(got) == len(want) and {(r.part, r.filter_order, r.step): tuple(r)[3:9] for r in got} == want
    assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in got)
    # a part without failures has zeros; fewer filters have fewer orders; no rows, no parts
    clean = filter_audit.audit_filters(table(spark, [(1, " ".join(f"w{i}" for i in range(200)), "xx", "a")]), labels)
    assert {tuple(r)[3:] for r in clean.collect()} == {(1, 0, 0, 0, 0, 0, 0)} and clean.count() == 600
    assert filter_audit.audit_filters(table(spark, rows), labels.limit(0), letters="AE").groupBy("part").count().where("count != 4").isEmpty()
    assert filter_audit.audit_filters(table(spark, []), labels).count() == 0


def source_rows(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    for lang in {d[0] for d in docs}:
        held = Counter(t for g, _, ws in docs if g == lang for t in set(ws))
        terms = sorted((t for t, n in held.items() if n >= least), key=str.encode)
        counts = defaultdict(Counter)
        for g, s, ws in docs:
            if g == lang:
                counts[s].update(w for w in ws if w in set(terms))
        whole = sum(counts.values(), Counter())

        def shares(c, terms=terms):
            return [1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(terms)) for t in terms]

        q = shares(whole)
        for s in counts:
            p = shares(counts[s])
            f = lambda a, b: (a - b) ** 2 // (a + b)
            pairs = sorted(((-sum(map(f, p, shares(counts[o]))), o.encode(), o) for o in counts if o != s))
            told = sorted((-f(a, b), t.encode(), t) for t, a, b in zip(terms, p, q, strict=True) if counts[s][t] and a > b)[:top]
            for part, items in (("pair", pairs), ("term", told)):
                yield from ((lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(items, 1))


@pytest.mark.parametrize(("least", "top"), [(3, 10), (1, 2), (1000, 5)])
def test_source_audit(spark, monkeypatch, least, top):
    monkeypatch.setattr(source_audit, "SALTS", 3)
    monkeypatch.setattr(source_audit, "PART", 7)
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefgÀé日", k=draw.randint(1, 3))) for _ in range(150)]
    rows = some_rows(5, 60) + [
        (i, " ".join(draw.choices(words, weights=[1 / (1 + (j * (1 + i % 3)) % 40) for j in range(150)], k=60)) + "-Zz9zZ", draw.choice(["en", "de"]), draw.choice(["a", "b", "c", "ü", None])) for i in range(80)
    ] + [(900, None, "fr", "z"), (901, "", "fr", "y")]
    got = source_audit.audit_sources(table(spark, rows), least_docs=least, top=top)
    assert sorted(map(tuple, got.collect())) == sorted(source_rows(rows, least, top))


def test_source_audit_no_rows(spark):
    assert source_audit.audit_sources(table(spark, [])).count() == 0
    assert source_audit.audit_sources(table(spark, [(1, "one", "en", "a")])).count() == 0


def test_counts_are_handed_on_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_audit, "HELD", 3)
    texts = ["a b c", "c d a a", None, "e"]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "source": ["s", "s", "s", "t"], "text": pa.array(texts, pa.string())})
    total, docs = Counter(), Counter()
    parts = list(source_audit._counted([batch]))
    for r in (row for b in parts for row in b.to_pylist()):
        total[r["source"], r["term"]] += r["n"]
        docs[r["source"], r["term"]] += r["docs"]
    assert total == {("s", "a"): 3, ("s", "b"): 1, ("s", "c"): 2, ("s", "d"): 1, ("t", "e"): 1} and docs["s", "a"] == 2 and docs["s", "c"] == 2 and len(parts) > 2


@pytest.mark.parametrize("k", [1, 3, 10])
def test_skyband(k):
    draw = np.random.default_rng(k)
    for _ in range(20):
        n = int(draw.integers(0, 300))
        counts, wholes = draw.integers(0, 12, n), draw.integers(0, 30, n)
        order = draw.permutation(n)
        over = (counts[None] >= counts[:, None]) & (wholes[None] <= wholes[:, None]) & (order[None] < order[:, None])
        assert set(source_audit.skyband(order, counts, wholes, k, step=37)) == set(np.flatnonzero(over.sum(axis=1) < k))


def test_shares_are_exact():
    """Counts up to what 64 bits hold after the first step, against whole numbers of Python."""
    draw = random.Random(6)
    rows = [(n, n + draw.randint(0, 10**13), draw.randint(1, 10**9)) for n in (0, 1, 12_345, 10**9, 10**12, 8 * 10**13)]
    assert all(source_audit.scaled_share(np.array([n]), total, terms)[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms) for n, total, terms in rows)
