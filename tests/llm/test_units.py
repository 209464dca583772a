"""The operators' parts against brute force, published values and the libraries they rebuild."""

import random
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from vantage.llm import language_id, lm_scoring, near_dedup, sentencepiece_codec, substring_dedup, token_counts, toxicity

PARTS = ["a", "'s", "'", "  ", " ", "\n", "\t", "é", "<|endoftext|>", "<|endof", "text|>", "1", "23", "!", "?!", "　", "\x1c", "漢", "the", "x" * 30, "\U0001f600"]


def odd_texts(n: int, seed: int = 1) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 120))) for _ in range(n)]


def test_token_counts_equal_the_library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = odd_texts(800)
    want = [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.UnitCounter(tokenizer).counts(texts) == want
    for chunk, overlap in ((5, 1), (20, 4), (40, 10)):
        counter = token_counts.ResyncCounter(tokenizer, chunk, overlap, len("<|endoftext|>"))
        assert [counter.count(t) for t in texts] == want
        assert counter.widened


def test_codec_equals_sentencepiece():
    model = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    codec, reference = sentencepiece_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [*odd_texts(800), "", " ", "trailing ", " both  sides ", "line\nbreak \n"]
    ids, sizes, parity, back = codec.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == reference.encode(texts)
    assert parity.all() and back.all()
    assert codec.tokenizer.decode_batch(reference.encode(texts), skip_special_tokens=False) == texts


def test_signatures_are_unbiased():
    signer = near_dedup.Signer(5, 200, 10)
    texts = ["a b c d e f g h i j k " * 3 + "x y z w v u t s", "a b c d e f g h i j k " * 2 + "x y z w v u t s r q", "p " * 40, "p " * 30, "one two", "one two", "", None]
    registers = signer.registers(*signer._elements(texts), len(texts))
    for i, j in pairwise(range(6)):
        true = near_dedup.similarity(*(near_dedup.shingles(lm_scoring.words_of(texts[k]), 5) for k in (i, j)))
        assert (registers[i] == registers[j]).mean() == pytest.approx(true, abs=0.05)
    assert np.isinf(registers[6:]).all()
    assert signer.sign(["", None])[0] == [None, None]


def test_common_length():
    assert substring_dedup.common_length(list("abcbdab"), list("bdcaba")) == 4
    assert substring_dedup.common_length([], ["x"]) == 0


def test_chains_keep_order():
    chains = substring_dedup.chain([0, 10, 20, 30, 5], [100, 110, 120, 130, 7], 5, 0.05)
    assert chains[0] == (0, 35, 100, 135) and (5, 10, 7, 12) in chains
    assert substring_dedup.chain([], [], 5, 0.05) == []


def test_cutting_words():
    assert substring_dedup.without("a b  c\nd e", [(1, 3)]) == "a d e"
    assert substring_dedup.without("a b c", [(0, 2), (1, 3)]) == ""
    assert substring_dedup.without("a b c", [(2, 9)]) == "a b "


@pytest.mark.parametrize("order", [1, 2, 3])
def test_walk_equals_side_by_side(order):
    texts = ["the cat sat on the mat", "the cat ran", "", None, "a cat sat"]
    block = lm_scoring.Block(texts, order)
    totals = block.counts(np.array([True, True, True, False, False]))
    automaton = lm_scoring.Automaton(block, totals, 12, 3.0, 0.5)
    ends = np.cumsum(block.sizes)
    assert automaton.scores() == pytest.approx([automaton.walk(int(e - n), int(e)) for n, e in zip(block.sizes, ends, strict=True)])


def test_mixture_finds_two_languages():
    words = {"x": "aaa aba bab abb", "y": "zzz zyz yzy zyy"}
    table = np.stack([np.bincount(language_id.trigram_cells(w.split(), 4096)[0], minlength=4096) for w in words.values()]) + 0.01
    model = language_id.MixtureModel(list(words), np.log(table / table.sum(1, keepdims=True)), 1.0, 3)
    one, both, none, empty = model.infer(["aaa aba " * 30, "aaa aba zzz " * 30, "12 !?", None])
    assert one[0] == "x" and one[2] == ["x"] and one[1] == pytest.approx(1)
    assert both[0] == "x" and both[2] == ["x", "y"] and both[1] == pytest.approx(2 / 3, abs=0.02)
    assert none == empty == ("und", 0.0, [], [])


def test_chain_learns_words_and_beginnings():
    draw = random.Random(3)
    good, bad = [f"word{i}" for i in range(200)], ["nastyone", "nastyish", "nastiest"]
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        texts.append(" ".join(draw.choices(good, k=20) + [draw.choice(bad)] * toxic))
        labels.append([int(i % 3 == 0), int(toxic)])
    features = toxicity.Features()
    chain = toxicity.Chain(4).fit([np.array(sorted(features.cells(t))) for t in texts], np.arange(400) % 4, np.array(labels))
    p = chain.predict([features.cells(t) for t in ("word1 word2 nastyone", "word3 word4", "word5 nastyfied", "")])[:, 1]
    assert p[0] > 0.5 and p[2] > 0.3 and p[1] < 0.2 and p[3] < 0.2
    assert (toxicity.Chain().fit([], np.zeros(0, int), np.zeros((0, 2))).predict([set()]) < 0.01).all()


def test_parts_of_runs():
    a, b = [*"abcdefgh", *"12345", *"ijklmnop"], [*"abcdefgh", *"67", *"ijklmnop"]
    assert len(substring_dedup.common_words(list("abcbdab"), list("bdcaba"))) == 4 and substring_dedup.common_words([], ["x"]) == []
    runs = substring_dedup.runs_of(a, b, [(2, 2), (14, 11)], 5)
    assert runs == [[0, 0, 8], [13, 10, 8]]
    assert substring_dedup.parts(runs, 6, 0.8, 5) == [(0, 8, 0, 8, 1.0), (13, 21, 10, 18, 1.0)]
    assert substring_dedup.parts(runs, 6, 0.7, 5) == [(0, 21, 0, 18, 16 / 21)]
    assert substring_dedup.parts([], 6, 0.8, 5) == []


def test_passages_that_cover_all_words():
    turns = [(i, i + 72, 0, 72, 1.0) for i in range(0, 300, 2)]
    kept = substring_dedup.covering([*turns, (400, 460, 5, 65, 0.9), (400, 455, 5, 60, 1.0)])
    covered = lambda rows: {w for r in rows for w in range(r[0], r[1])}
    assert covered(kept) == covered([*turns, (400, 460, 5, 65, 0.9)]) and len(kept) <= 10 and kept[-1] == (400, 460, 5, 65, 0.9)
    assert substring_dedup.covering([(0, 60, 0, 60, 1.0), (55, 120, 80, 145, 1.0)]) == [(0, 60, 0, 60, 1.0), (55, 120, 80, 145, 1.0)]


def test_pairs_of_seeds_go_with_the_nearest_of_equal_ones():
    import numpy as np

    at, codes = np.arange(0, 60, 5), np.array([7, 8] * 6)
    i, j, code = substring_dedup.pairs_of(at, codes, np.arange(12) % 2, np.zeros(12, np.int64), 5, 50)
    assert set((at[j] - at[i]).tolist()) == {5} and len(set(code.tolist())) == 2 and len(i) == 11
    one = substring_dedup.pairs_of(np.array([0, 20]), np.array([7, 8]), np.array([1, 1]), np.array([100, 121]), 5, 50)
    assert len(one[0]) == 0


def test_new_units_are_coded_in_runs():
    """Many new units go through the tokenizer as few texts, and each has the ids, parity and round trip that it has by itself."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    draw = random.Random(4)
    units = sorted({"".join(draw.choice("abehnortüé日<0x>.\n▁") for _ in range(draw.randint(1, 12))) for _ in range(2000)}) + ["", " a", "b  "]
    ready = sentencepiece_codec.prepared(model)
    codec, alone = sentencepiece_codec.Codec(model, ready=ready), sentencepiece_codec.Codec(model, ready=ready)
    asked, tokenizer = [], codec.tokenizer

    class Counted:
        decode_batch = tokenizer.decode_batch

        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, **how)

    codec.tokenizer = Counted()
    plain = [u for u in units if u and " " not in u and "▁" not in u]
    codec._learn(plain)
    assert len(asked) == -(-len(plain) // sentencepiece_codec.RUN)
    got = codec.encode(units)
    by_one = [alone.encode([u]) for u in units]
    for column, parts in zip(got, zip(*by_one, strict=True), strict=True):
        assert column.tolist() == [x for p in parts for x in p.tolist()]
    assert got[1].tolist() == [len(alone.tokenizer.encode(u, add_special_tokens=False).ids) if u else 0 for u in units]


def test_pairs_of_several_documents_at_once():
    """Documents after each other, their places far apart, have the pairs that each has by itself."""
    draw = np.random.default_rng(3)
    docs = [(np.sort(draw.choice(4 * n + 1, n, replace=False)), draw.integers(-40, 40, n), draw.integers(0, 3, n), draw.integers(0, 99, n)) for n in (0, 1, 60, 90, 2)]
    first = np.cumsum([0, *(len(d[0]) for d in docs)])
    at, codes, source, place = (np.concatenate(x) for x in zip(*docs, strict=True))
    got = substring_dedup.pairs_of(at + (np.repeat(np.arange(len(docs)), np.diff(first)) << 40), codes, source, place, 5, 50)
    want = [(i + n, j + n, c) for n, d in zip(first.tolist(), docs, strict=False) for i, j, c in zip(*(x.tolist() for x in substring_dedup.pairs_of(*d, 5, 50)), strict=True)]
    assert want and sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


def test_seeds_of_many_texts_at_once():
    """Texts of a batch have the seeds that each has by itself, and a word that they share is hashed once."""
    draw = random.Random(8)
    texts = ["".join(draw.choice("aAbZ é日\t\n\v\f\r\x1c\x85") for _ in range(draw.randint(0, 400))) for _ in range(300)] + ["", " ", "a", " a"]
    for least, k, window in ((50, 5, 10), (14, 5, 10), (3, 5, 10), (1, 1, 1)):
        at, codes = substring_dedup.seeds_in(pa.array(["x " * 60, *texts]).slice(1), least, k, window)
        for text, a, c in zip(texts, at.to_pylist(), codes.to_pylist(), strict=True):
            words = [xxhash.xxh3_64_intdigest(w) for w in lm_scoring.words_of(text)]
            p, q = substring_dedup.seeds_of(np.array(words, np.uint64), k, window)
            assert (a, c) == ((p.tolist(), q.view(np.int64).tolist()) if len(words) >= least else (None, None))
    words, ends = substring_dedup.words_in(pa.array(["a b", "", "c\na "]))
    assert ends.tolist() == [0, 2, 2, 4] and words[0] == words[3] == xxhash.xxh3_64_intdigest(b"a")


def test_chains_of_seeds_that_rise_on_both_sides():
    """Without the tree they are those that it finds: a foreign pair of places far behind all others, which takes part in no chain, brings the tree in."""
    draw = random.Random(2)
    for _ in range(200):
        pos, source = (sorted(draw.sample(range(900), 12)) for _ in range(2))
        plain = substring_dedup.chained(pos, source, 5, 0.05)
        assert [c for c in substring_dedup.chained([*pos, 10**6], [*source, -1], 5, 0.05) if c != [12]] == plain


def test_stretches_of_several_documents_at_once():
    draw = np.random.default_rng(5)
    docs = [(np.sort(draw.choice(3 * n + 1, n, replace=False)), draw.integers(-40, 40, n), draw.integers(0, 2, n), draw.integers(0, 99, n)) for n in (0, 1, 60, 90, 2)]
    first = np.cumsum([0, *(len(d[0]) for d in docs)])
    at, codes, source, place = (np.concatenate(x) for x in zip(*docs, strict=True))
    far = np.repeat(np.arange(len(docs)), np.diff(first)) << 40
    got = substring_dedup.stretches_of(at + far, codes, source, place + far, 5, 10, 50)
    want = [(i + n, c, m) for n, d in zip(first.tolist(), docs, strict=False) for i, c, m in zip(*(x.tolist() for x in substring_dedup.stretches_of(*d, 5, 10, 50)), strict=True)]
    assert want and list(zip(*(x.tolist() for x in got), strict=True)) == want
