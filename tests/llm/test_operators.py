"""Each operator on small tables: results against brute force, and nulls, empties, ties, repeats and clashing columns."""

import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vantage.llm import decontamination, language_id, lm_scoring, near_dedup, quality_rules, sentencepiece_codec, sharding, substring_dedup, token_counts, toxicity
from vantage.llm.near_dedup import shingles, similarity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
draw = random.Random(11)


def words(n):
    return ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


PASSAGE, ITEM = words(60), words(30)
BASE = words(80)
TEXTS = [
    " ".join(BASE), " ".join(BASE), " ".join([*BASE[:-1], "changed"]), " ".join(words(40) + PASSAGE), " ".join(words(30) + PASSAGE + words(20)), " ".join(words(10) + ITEM + words(40)),
    None, "", "  \n ", "one two three", "one  two\nthree", "x" * 50_000 + " end", "the same line\n" * 20, " ".join(words(60)).upper(),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 1), (None, "no id here at all", "en", None, None)]
    clash = ["bucket", "block", "node", "label", "words", "cell", "level", "at"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in clash}).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 0, 1), (3, 0, 1), (5, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(ITEM)), (2, " ".join(ITEM)), (3, None), (4, "zq zw"), (5, "")], "item_id long, text string")


def test_backoff_scores(docs):
    rows = lm_scoring.score_documents(docs, block_bytes=1000).collect()
    assert len(rows) == docs.count()
    train = [t for i, t in docs.select("doc_id", "text").collect() if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    tokens = [w for t in train for w in [*lm_scoring.words_of(t), lm_scoring.END]]
    counts = Counter(tokens)
    assert {r.train_tokens for r in rows} == {len(tokens)}
    for r in rows:
        if r.doc_id == 9:
            mine = [b"one", b"two", b"three", lm_scoring.END]
            assert r.n_tokens == 4 and r.n_known == sum(counts[w] > 0 for w in mine)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (len(tokens) + len(counts) + 1)) for w in mine))
    assert lm_scoring.score_documents(docs.limit(0)).count() == 0


def test_shards(docs):
    def jump(key, n):
        b, j, key = -1, 0, key & (2**64 - 1)
        while j < n:
            b = j
            key = (key * sharding.LCG_MULTIPLIER + 1) & (2**64 - 1)
            j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    rows = sharding.shard_documents(docs, 24).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, 24), jump(r.doc_id or 0, 25)) and r.grown_shard in (r.shard, 24)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_tokens(docs):
    rows = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), chunk_chars=1000, overlap_chars=10).collect()
    whole = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), chunk_chars=1 << 20).collect()}
    assert len(rows) == docs.count() and all(r.n_tokens == whole[r.doc_id] for r in rows)
    encoded = sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode_documents(encoded, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert encoded.where("not parity or not round_trip").count() == 0


def test_near_duplicates(docs):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[9] == got[10] == 9 and got[6] == 6 and got[None] is None
    assert all(got[i] == i for i in (3, 4, 5, 7, 8, 11, 12, 13))
    assert near_dedup.near_duplicate_classes(docs.limit(0)).count() == 0


def test_near_duplicate_group_without_centre(spark):
    """Neighbours in a long chain are alike, its ends aren't: the class must still be one."""
    long = words(200)
    rows = [(i, " ".join(long[i * 4 : i * 4 + 120])) for i in range(20)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = similarity(shingles(rows[0][1].split(), 5), shingles(rows[1][1].split(), 5))
    assert near >= 0.8 and set(got.values()) == {0}


def test_near_duplicates_equal_brute_force(spark):
    """Families of edited copies, some of them unlike each other, texts that share a passage, exact copies, shared ids, clashing columns."""
    rows, common = [], words(60)
    for _ in range(12):
        base = words(90)
        for _ in range(9):
            edited = [words(1)[0] if draw.random() < draw.choice([0, 0.01, 0.03]) else w for w in base]
            rows.append((len(rows), " ".join(edited)))
    rows += [(len(rows) + i, " ".join(common + words(30))) for i in range(60)]
    rows += [(len(rows) + i, rows[0][1]) for i in range(50)]
    rows += [(rows[5][0], rows[20][1]), (None, rows[30][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "bucket", "label", "n", "copies", "part", "cell")})
    texts = sorted({t for _, t in rows})
    sets = [shingles(t.split(), 5) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    of = dict(zip(texts, root, strict=True))
    least = {r: min(i for i, t in rows if i is not None and of[t] == r) for r in set(root)}
    got = sorted((str(r.doc_id), r.class_id) for r in near_dedup.near_duplicate_classes(df).collect())
    assert got == sorted((str(i), least[of[t]]) for i, t in rows)
    small = near_dedup.text_classes(df, part_rows=5, block_rows=3, cell_rows=50, cell_bytes=4000)[1]
    classes = {}
    for r in small.collect():
        classes.setdefault(bytes(r.label), set()).add(bytes(r.node))
    import hashlib

    want = {}
    for t in texts:
        want.setdefault(of[t], set()).add(hashlib.md5(t.encode()).digest())
    assert sorted(map(sorted, classes.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1)


def test_repeated_passages_with_earlier_fragments(spark):
    """Earlier documents each hold a part of a passage that two later ones share whole; rows that share an id."""
    passage = words(60)
    texts = [words(20) + passage[i * 4 : i * 4 + 14] + words(20) for i in range(11)] + [words(30) + passage + words(10), words(5) + passage + words(25)]
    rows = [(90 + i, " ".join(t)) for i, t in enumerate(texts)] + [(102, " ".join(words(80))), (300, " ".join(words(70))), (300, " ".join(passage))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeated_passages(df)
    assert {(r.doc_id, r.start_word, r.end_word, r.source_doc_id) for r in found.collect()} >= {(102, 5, 65, 101), (300, 0, 60, 101)}
    left = substring_dedup.remove_passages(df.withColumns({"_spans": F.lit(1), "_id": F.lit(2)}), found).collect()
    sizes = {(r.doc_id, len(r.text.split())) for r in left if r.doc_id > 101}
    assert len(left) == len(rows) - 1 and sizes == {(102, 30), (102, 80), (300, 70)}, found.collect()


def test_repeated_passages(docs):
    rows = substring_dedup.repeated_passages(docs).collect()
    found = {(r.doc_id, r.source_doc_id): (r.start_word, r.end_word) for r in rows}
    assert found[4, 3] == (30, 90) and found[1, 0] == (0, 80) and {d for d, _ in found} == {1, 2, 4}
    left = substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs)).collect()
    texts = {r.doc_id: r.text for r in left}
    assert 1 not in texts and len(texts[4].split()) == 50 and texts[3] == TEXTS[3] and left[0].__fields__ == docs.columns
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("foreign", [(40, 40), (120, 60), (200, 200), (0, 150)])
def test_repeated_passages_of_one_pair(spark, foreign):
    """Two passages with other words between them, as many or not on both sides: each is found by itself."""
    one, two = words(55), words(55)
    texts = [words(20) + one + words(n) + two + words(20) for n in foreign]
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    found = sorted((r.start_word, r.end_word, r.source_start, r.source_end, r.identity) for r in rows)
    assert found == [(20, 75, 20, 75, 1.0), (75 + foreign[1], 130 + foreign[1], 75 + foreign[0], 130 + foreign[0], 1.0)]


def test_repeated_passages_cover_all_exact_runs(spark):
    """All pairs by brute force: each word inside a run of 50 words or more that a smaller id has lies in a found passage, identities are as stated.

    Not so the last words of a run, fewer than a seed is sure to lie in, that the first owner of the words before lacks.
    """
    pool, texts = [words(draw.randint(50, 90)) for _ in range(8)], []
    for i in range(40):
        parts = [words(draw.randint(5, 60))]
        for one in draw.sample(pool, draw.randint(0, 3)):
            parts += [one if i % 4 else one[: draw.randint(50, len(one))], words(draw.randint(5, 60))]
        texts.append(sum(parts, []))
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    covered = {(r.doc_id, w) for r in rows for w in range(r.start_word, r.end_word)}
    want = set()
    for i, t in enumerate(texts):
        earlier = {tuple(x[s : s + 50]) for x in texts[:i] for s in range(len(x) - 49)}
        want |= {(i, s + j) for s in range(len(t) - 49) if tuple(t[s : s + 50]) in earlier for j in range(50)}
    missed = want - covered
    assert len(want) > 1000 and len(missed) <= 0.005 * len(want), sorted(missed)
    assert all(any((i, w - j) in covered for j in range(1, 14)) or any((i, w + j) in covered for j in range(1, 14)) for i, w in missed), sorted(missed)
    for r in rows:
        mine, source = texts[r.doc_id][r.start_word : r.end_word], texts[r.source_doc_id][r.source_start : r.source_end]
        assert r.source_doc_id < r.doc_id and len(mine) >= 50 and sum((Counter(mine) & Counter(source)).values()) >= 0.8 * max(len(mine), len(source))


@pytest.mark.parametrize("lines", [2, 3])
def test_repeated_passages_of_lines_from_elsewhere(spark, lines):
    """A passage whose lines, and each two neighbours of them, occur first in different earlier documents."""
    line = [words(60 // lines) for _ in range(lines)]
    earlier = [words(20) + part + words(20) for part in line] + [words(20) + line[i] + line[i + 1] + words(20) for i in range(lines - 1) if lines > 2]
    texts = [*earlier, words(30) + sum(line, []) + words(10), words(15) + sum(line, []) + words(25)]
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    b, c = len(texts) - 2, len(texts) - 1
    assert [(r.start_word, r.end_word, r.source_start, r.source_end) for r in rows if (r.doc_id, r.source_doc_id) == (c, b)] == [(15, 75, 30, 90)]
    assert {(r.doc_id, r.source_doc_id) for r in rows} == {(c, b)}


def test_repeated_passages_with_edits(spark):
    """Of passages of 60 words with 9 changed, three quarters are found; with 2 changed all are."""
    rows, changed = [], {}
    for i in range(120):
        one = words(60)
        places = draw.sample(range(60), n := 9 if i < 100 else 2)
        other = [words(1)[0] if j in places else w for j, w in enumerate(one)]
        rows += [(2 * i, " ".join(words(40) + one + words(60))), (2 * i + 1, " ".join(words(90) + other + words(20)))]
        changed[2 * i + 1] = n
    found = {r.doc_id for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(changed[d] == 9 for d in found) >= 75 and sum(changed[d] == 2 for d in found) == 20


def test_repeated_passages_with_edits_and_earlier_fragments(spark):
    """Two later documents share a passage with six words changed; twelve earlier ones each hold 14 words of it, and others lie between."""
    rows, wanted = [], set()
    for i in range(40):
        one, base = words(60), 100 * i
        places = draw.sample(range(60), 6)
        other = [words(1)[0] if j in places else w for j, w in enumerate(one)]
        rows += [(base + n, words(20) + one[at : at + 14] + words(20)) for n, at in enumerate(range(0, 47, 4))]
        rows.append((base + 20, words(30) + one + words(10)))
        rows += [(base + 21 + n, words(20) + one[at : at + 14] + words(20)) for n, at in enumerate(range(0, 47, 4))]
        rows.append((base + 40, words(15) + other + words(25)))
        wanted.add((base + 40, base + 20))
    found = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()
    assert len({(r.doc_id, r.source_doc_id) for r in found} & wanted) >= 38
    assert {(r.doc_id, r.source_doc_id) for r in found} <= wanted


@pytest.mark.parametrize("most_listed", [20_000, 0])
def test_contamination(docs, benchmark, most_listed):
    rows = decontamination.contaminated_documents(docs, benchmark, most_listed=most_listed).collect()
    assert {(r.doc_id, r.item_id, r.similarity, r.start_word, r.distance) for r in rows} == {(5, 1, 1.0, 10, 0), (5, 2, 1.0, 10, 0)}
    assert decontamination.contaminated_documents(docs, benchmark.limit(0)).count() == 0
    assert decontamination.contaminated_documents(docs.limit(0), benchmark).count() == 0


def test_contamination_by_items_that_share_or_lack_an_id(spark, docs):
    other = words(30)
    bench = spark.createDataFrame([(1, " ".join(ITEM)), (1, " ".join(other)), (None, " ".join(ITEM)), (None, None)], "item_id long, text string")
    rows = decontamination.contaminated_documents(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.similarity, r.distance) for r in rows} == {(5, 1, 1.0, 0), (5, None, 1.0, 0)} and len(rows) == 2


def test_contamination_equals_brute_force(spark):
    """All windows of an item's length against all items, without anchors and fingerprints: words changed, put in, left out, parts moved, lines repeated."""
    items = [words(draw.randint(12, 40)) for _ in range(12)]
    items += [words(6) * 5 + words(10), words(70), words(90)]
    texts = []
    for i in range(90):
        item = list(items[i % 15])
        for _ in range(draw.randint(0, 4) if i % 3 else 0):
            at = draw.randrange(len(item))
            item[at : at + draw.randint(0, 1)] = words(draw.randint(0, 2))
        if i % 5 == 0:
            item = item[len(item) // 2 :] + item[: len(item) // 2]
        texts.append(words(draw.randint(0, 30)) + (item if i % 7 else item[: len(item) // 2]) + words(draw.randint(20, 60)) + item * (i % 4 == 0) + words(draw.randint(0, 8)))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            best = max((similarity(shingles(t[s : s + len(item)], 5), shingles(item, 5)) for s in range(max(len(t) - 4, 1))), default=0)
            if best >= 0.8:
                want[i, j] = best
    for listed, sent in ((20_000, 2_000_000), (0, 0)):
        rows = decontamination.contaminated_documents(docs, bench, most_listed=listed, most_sent=sent).collect()
        got = {(r.doc_id, r.item_id): r.similarity for r in rows}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want) and len(want) > 30


def test_contamination_by_long_items(spark):
    """An item of 5,000 words with a line that repeats, in documents that lack some of its words or have others besides."""
    item = words(2500) + words(8) * 10 + words(2420)
    put_in, left_out = list(item), [w for i, w in enumerate(item) if i % 97]
    for at in range(4900, 0, -120):
        put_in[at:at] = words(2)
    texts = [words(50) + item + words(50), words(10) + put_in + words(10), left_out + words(300), words(5000), item[:2500] + words(2500)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "zz yy")], "item_id long, text string")
    got = {r.doc_id: (r.start_word, r.similarity) for r in decontamination.contaminated_documents(docs, bench).collect()}
    assert got.keys() == {0, 1, 2} and got[0] == (50, 1.0)
    for i in (1, 2):
        best = similarity(shingles(texts[i][got[i][0] : got[i][0] + len(item)], 5), shingles(item, 5))
        assert got[i][1] == pytest.approx(best) and best >= 0.8


def test_quality(docs):
    rows = {r.doc_id: r for r in quality_rules.judge_quality(docs).collect()}
    for i, t in enumerate(TEXTS):
        ws = (t or "").split()
        grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        covered = {j for k, g in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if grams[g] > 1 for j in (k, k + 1, k + 2)}
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_repeat_words) == (len(ws), sum(map(len, ws)), len(covered)), i
        assert rows[i].base_failed == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws))
    assert rows[12].n_dup_lines == 19 and not rows[12].kept and not rows[6].kept
    assert quality_rules.judge_quality(docs.limit(0)).count() == 0


def test_quality_equals_brute_force(spark):
    """Symbols, distances and verdicts, the references counted by hand over the other documents; a language of one junk text, and of few words."""
    import re

    def text(vocabulary, n):
        return "".join(draw.choice(vocabulary) + draw.choice([" ", " ", ", ", "\n", ". A", " 7"]) for _ in range(n))

    mine, other = words(60) + ["a", "the", "of"] * 20, [w.upper() for w in words(50)] + ["é", "ü", "über"] * 10
    rows = [(i, text(mine, 120), "en") for i in range(30)] + [(30 + i, text(other, 110), "de") for i in range(25)]
    rows += [(60, "|#$% <>* |#$ %& " * 80, "xx"), (61, text(other, 150), "yy"), (62, text(mine, 60), "yy"), (63, "|| ## " * 90, "en"), (64, text(other, 200), "en"), (65, None, None), (66, text(mine, 20), None)]
    space = "[ \t-\r]"
    kinds = [space, "[A-Z]", "[0-9]", "[#*$%&|<>]", quality_rules.CLASSES["marks"], "[^\x00-\x7f]"]
    classes = {i: [float(len(re.findall(p, t or ""))) for p in kinds] for i, t, _ in rows}
    for i, t, _ in rows:
        classes[i].append(len(t or "") - sum(classes[i]))
    by_lang, commons = {}, {}
    for _, t, lang in rows:
        by_lang.setdefault(lang, Counter()).update(w for w in (t or "").lower().split() if len(w) <= 6 and w.isalpha())
    listed = {lang: sorted(c, key=lambda w: (-c[w], w.encode()))[:16] for lang, c in by_lang.items()}
    for i, t, lang in rows:
        ws = (t or "").lower().split()
        commons[i] = [float(sum(w not in listed[lang] for w in ws))] + [float(ws.count(w)) for w in listed[lang]]

    def apart(p, q):
        if not sum(p) or not sum(q):
            return None
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
        return math.sqrt(min(max(sum(kl(x, y) + kl(y, x) for x, y in zip(p, q, strict=True)) / 2, 0), 1))

    added = lambda arrays, n: [sum(a[j] for a in arrays) for j in range(n)]
    got = {r.doc_id: r for r in quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    for i, t, lang in rows:
        same, all_others = [j for j, _, x in rows if x == lang and j != i], [j for j, _, _ in rows if j != i]
        own, enough = sum(sum(commons[j]) for j in same) >= 1000, sum(sum(commons[j]) for j in all_others) >= 1000
        c = apart(classes[i], added([classes[j] for j in (same if own else all_others)], 7)) if own or enough else None
        w = apart(commons[i], added([commons[j] for j in same], len(commons[i]))) if own else None
        far = (sum(classes[i]) >= 200 and c is not None and c > 0.25) or (sum(commons[i]) >= 100 and w is not None and w > 0.27)
        r = got[i]
        assert r.class_distance == (None if c is None else pytest.approx(c, abs=1e-9)) and r.word_distance == (None if w is None else pytest.approx(w, abs=1e-9)), i
        assert r.kept == (not r.base_failed and not far) and r.n_symbols == classes[i][3], i
    assert got[60].class_distance > 0.5 and got[61].word_distance is None and got[64].word_distance > 0.27 and any(r.kept for r in got.values())


def test_js_distance(spark):
    row = spark.range(1).select(*(quality_rules.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias(n) for n, p, q in (
        ("same", (1.0, 3.0), (2.0, 6.0)), ("apart", (1.0, 0.0), (0.0, 5.0)), ("empty", (0.0, 0.0), (1.0, 1.0)),
    ))).first()
    assert (row.same, row.apart, row.empty) == (0.0, 1.0, None)


def test_languages(docs):
    rows = language_id.identify_languages(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (6, 7, 8)} == {"und"} and {r.lang_pred for r in rows} == {"en", "und"}
    assert {r.lang_pred for r in language_id.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify_languages(docs.limit(0)).count() == 0


def test_toxicity(docs, labels):
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and not any(r.toxic for r in rows if r.doc_id in (6, 7))
    assert not any(r.toxic for r in toxicity.score_toxicity(docs, labels.limit(0)).collect())
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_pipeline_stages(spark, docs, labels, benchmark, tmp_path):
    import corpus_pipeline

    docs.withColumns({c: F.lit("x") for c in ("_nth", "_node", "_spans", "_id", "_key")}).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {1, 2, 5, 10}.isdisjoint(kept) and {0, 3, 4, 6, 9, 11, 13, None} <= set(kept)
    assert all(r.parity and r.round_trip for r in kept.values())


def test_pipeline_stages_take_small_batches(spark, tmp_path):
    """After a stage is called no task gets more than 1,000 rows of texts at a time; a smaller setting of the user's own stays."""
    import corpus_pipeline

    name = corpus_pipeline.BATCH_SETTING
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).coalesce(1)
    most = lambda: max(r.n for r in docs.mapInPandas(lambda batches: (b.assign(n=len(b))[["n"]][:1] for b in batches), "n long").collect())
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", 1000), ("0", 1000), ("700", 700)):
            spark.conf.set(name, given)
            corpus_pipeline.encode(spark, docs, str(tmp_path))
            assert most() == want
    finally:
        spark.conf.set(name, before)
