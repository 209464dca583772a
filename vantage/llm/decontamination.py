"""Finds benchmark items in documents: SimHash fingerprints of item-sized windows, in DataFrame expressions.

1. Windows. A window as long as an item, with a weighted Jaccard similarity t to it, lacks at most a share 1 - t of the
   item's shingles. So of any set of shingles with more than that share of the item's weight, one is in the window. Each
   item takes its longest words as anchors until the shingles that hold one are such a set; a document that has none of
   them has no such window. In the others every window of the item's length is weighed by the item's shingles in it, a
   repeated one up to its count in the item. Moving a window to its first such shingle loses none, so windows that begin
   with one, and the last of the document, stand for all. The best of each document and item is laid. There is no bound
   on where in the window an anchor lies, so words put in, left out or moved don't hide an item.
2. Candidates. A window's fingerprint is compared with those of all items of its length. 64 bits are cut into 8 blocks;
   items stand in an index under every value within 2 bits of each block. Two fingerprints within 23 bits agree within
   2 bits on some block, so the index misses none of them.
3. Verification. The weighted Jaccard similarity of the word shingles, a shingle's weight being its count, decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, cut, hot_keys, let, likely_among, salted_join

BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1


def words(text: Column) -> Column:
    """Lower-cased words; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_PATTERN), lambda w: w != "")


def shingle_count(n: Column, k: int) -> Column:
    return F.greatest(n - (k - 1), F.lit(1))


def tagged_shingles(ws: Column, k: int) -> Column:
    """The k-word shingles (all words if there are fewer), each tagged with how often it came before: sets that stand for multisets."""
    plain = F.transform(F.sequence(F.lit(1), shingle_count(F.size(ws), k)), lambda i: F.array_join(F.slice(ws, i, k), " "))

    def tagged(p: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda j: (j == 0) | (F.get(p, j - 1) != F.get(p, j)))
        run = lambda a, n: F.transform(F.sequence(F.lit(1), n), lambda q: F.concat(F.get(p, a), F.lit("\n"), q.cast("string")))
        return let(begins, lambda at: F.flatten(F.transform(at, lambda a, r: run(a, F.coalesce(F.get(at, r + 1), F.size(p)) - a))))

    return let(F.sort_array(plain), tagged)


def codes(ws: Column, k: int) -> Column:
    """The shingles' 64-bit hashes, in order."""
    return F.transform(F.sequence(F.lit(1), shingle_count(F.size(ws), k)), lambda i: F.xxhash64(F.slice(ws, i, k)))


def best_start(ws: Column, item_codes: Column, n: Column, k: int, threshold: float) -> Column:
    """Where the window of ``n`` words that shares most with an item begins (the first of equals); null if none can reach the threshold.

    At the text's end windows may be shorter than the item. Shingles are told apart by their hashes.
    """
    count, length = shingle_count(n, k), F.size(ws)
    width = lambda s: shingle_count(F.least(n, length - s), k)

    def of_places(at: Column, code: Column) -> Column:
        # how many places earlier an equal shingle lies that fills the last of its places in the item, by place
        def earlier(e: Column) -> Column:
            def before(x: Column, j: Column) -> Column:
                there = F.get(e, j - F.size(F.filter(item_codes, lambda c: c == x["code"])))
                repeated = F.get(e, j - 1)["code"] == x["code"]
                return F.struct(x["at"].alias("at"), F.when(repeated & (there["code"] == x["code"]), there["at"]).otherwise(-1).alias("full"))

            return F.sort_array(F.transform(e, before))

        def chosen(places: Column) -> Column:
            def weighed(s: Column) -> Column:
                shared = F.size(F.filter(places, lambda x: (x["at"] >= s) & (x["at"] < s + width(s)) & (x["full"] < s)))
                return let(shared, lambda w: F.struct((w / (count + width(s) - w)).alias("similarity"), (-s).alias("back")))

            # enough places of the item's shingles lie in the window, counted without looking at repeats
            enough = lambda s, j: F.get(at, j + F.ceil(threshold / (1 + threshold) * (count + width(s)) - 1e-6).cast("int") - 1) < s + width(s)
            begins = F.filter(F.transform(at, lambda s, j: F.when(enough(s, j), s)), lambda s: s.isNotNull())
            best = F.array_max(F.transform(F.array_append(begins, F.greatest(length - n, F.lit(0))), weighed))
            return let(best, lambda b: F.when(b["similarity"] >= threshold - 1e-9, -b["back"]))

        by_code = F.sort_array(F.transform(at, lambda i: F.struct(F.get(code, i).alias("code"), i.alias("at"))))
        return let(let(by_code, earlier), chosen)

    held = lambda code: F.filter(F.sequence(F.lit(0), F.size(code) - 1), lambda i: F.array_contains(item_codes, F.get(code, i)))
    return let(codes(ws, k), lambda code: let(held(code), lambda at: of_places(at, code)))


def simhash(shingles: Column) -> Column:
    """64 signs of the sums of +1 and -1 over the shingles' hash bits. The tag counts: a repeated shingle has weight."""

    def sign(hashes: Column) -> Column:
        def bit(acc: Column, b: Column) -> Column:
            total = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int") * 2 - 1)
            return acc.bitwiseOR(F.when(total > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), bit)

    return let(F.transform(shingles, lambda s: F.xxhash64(F.substring_index(s, "\n", 1))), sign)


def _block(fingerprint: Column, j: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, j * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _items(benchmark: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """item_key, item_id, n, shingles, codes, anchor_words, anchor_codes of each distinct item with a word."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("item_words")).where(F.size("item_words") > 0)
    items = items.withColumn("item_key", F.xxhash64("item_id", "item_words")).dropDuplicates(["item_key"]).withColumn("n", F.size("item_words"))
    count = shingle_count(F.col("n"), k)
    need = F.floor(F.round((1 - threshold) * count, 6)).cast("int") + 1
    # places of words, longest first
    order = F.transform(
        F.sort_array(F.transform("item_words", lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i")))), lambda s: s["i"]
    )

    def take(acc: Column, p: Column) -> Column:
        covers = F.array_union(acc["covered"], F.sequence(F.greatest(p - (k - 1), F.lit(0)), F.least(p, count - 1)))
        more = F.struct(covers.alias("covered"), F.concat(acc["anchors"], F.array(p)).alias("anchors"))
        return F.when(F.size(acc["covered"]) < need, more).otherwise(acc)

    start = F.struct(F.array().cast("array<int>").alias("covered"), F.array().cast("array<int>").alias("anchors"))
    items = items.select("*", tagged_shingles(F.col("item_words"), k).alias("shingles"), codes(F.col("item_words"), k).alias("codes"), F.aggregate(order, start, take).alias("taken"))
    return items.select(
        "item_key", "item_id", "n", "shingles", "codes", F.transform("taken.anchors", lambda p: F.get("item_words", p)).alias("anchor_words"),
        F.transform("taken.covered", lambda i: F.get("codes", i)).alias("anchor_codes"),
    )


def contaminated_documents(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    k: int = 5, threshold: float = 0.8, most_listed: int = 20_000, most_sent: int = 2_000_000,
) -> DataFrame:
    """doc_id, item_id, similarity, start_word, distance: a row for each document and item that it holds a window of.

    similarity is the best window's, start_word where that begins (from 0), distance its fingerprint's from the item's.
    Items' anchor words are looked up while a document's words are read: up to ``most_listed`` of them as a list in the
    plan (counted first); with more of them every shingle is looked up. Items' hashes are broadcast up to ``most_sent``
    of them (counted first), beyond that they are joined by shuffles. Only the texts with an anchor shingle are shuffled.

    Null and blank texts and items match nothing. An item of fewer than ``k`` words has one shingle. Documents without
    id are reported with a null id, rows that share an id together. Items without id are reported with a null id,
    items that share an id, repeated ones too, together. Empty tables: no rows. Other columns are ignored.
    """
    items = cut(_items(benchmark, item_id_col, item_text_col, k, threshold))
    sent = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= most_sent  # an item has at most as many hashes as words
    small = F.broadcast if sent else lambda df: df
    listed = [r[0] for r in items.select(F.explode("anchor_words")).distinct().limit(most_listed + 1).collect()]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))

    def looked_up(ws: Column) -> Column:
        if len(listed) > most_listed:
            return F.array_distinct(codes(ws, k))
        places = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(listed), i)), lambda i: i.isNotNull())
        around = lambda p: F.sequence(F.greatest(p - (k - 1), F.lit(0)), F.least(p, shingle_count(F.size(ws), k) - 1))
        return F.transform(F.array_distinct(F.flatten(F.transform(places, around))), lambda i: F.xxhash64(F.slice(ws, i + 1, k)))

    anchors = items.select("item_key", F.explode(F.array_distinct("anchor_codes")).alias("code"))
    hits = docs.select("doc_id", "key", F.explode(let(words(F.col("text")), looked_up)).alias("code"))
    pairs = cut(hits.join(small(anchors), "code").select("doc_id", "key", "item_key").distinct())
    weighed = items.select("item_key", "n", "codes")
    if sent:
        pairs_codes = pairs.join(F.broadcast(weighed), "item_key")
    else:
        pairs_codes = salted_join(pairs, weighed, "item_key", hot_keys(pairs.groupBy("item_key").count(), "item_key", "count"))
    texts = likely_among(docs, "key", pairs.select("key")).dropDuplicates(["key", "doc_id"]).select("key", F.col("doc_id").alias("_doc_id"), words(F.col("text")).alias("ws"))

    def laid(ws: Column) -> Column:
        window = lambda at: F.when(at.isNotNull(), F.array(F.struct(at.alias("start"), F.slice(ws, at + 1, F.col("n")).alias("words"))))
        return let(best_start(ws, F.col("codes"), F.col("n"), k, threshold), window)

    # exploded, not filtered: a filter would be pushed down and work the places out twice
    placed = pairs_codes.join(texts, (texts["key"] == pairs_codes["key"]) & F.col("_doc_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "n", F.explode(let(F.col("ws"), laid)).alias("window"))
    windows = placed.select("doc_id", "n", "window.start", "window.words").distinct().select("doc_id", "n", "start", tagged_shingles(F.col("words"), k).alias("window_shingles"))
    windows = windows.select("*", simhash(F.col("window_shingles")).alias("fingerprint"))
    masks = [sum(1 << b for b in bits) for r in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), r)]
    index = items.select("item_id", "item_key", "n", simhash(F.col("shingles")).alias("item_fingerprint"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    index = index.select("*", blocks).select("*", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select(
        "item_id", "item_key", "n", "item_fingerprint", "block", _block(F.col("item_fingerprint"), F.col("block")).bitwiseXOR(F.col("mask")).alias("value")
    )
    near = (
        windows.select("*", blocks).withColumn("value", _block(F.col("fingerprint"), F.col("block"))).join(index, ["n", "block", "value"])
        .withColumn("distance", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint")))).where(F.col("distance") <= RADIUS)
    )
    # the index has an item's key 296 times, its shingles come once
    pairs = near.join(items.select("item_key", F.col("shingles").alias("item_shingles")), "item_key")
    shared = F.size(F.array_intersect("window_shingles", "item_shingles"))
    scored = pairs.withColumn("similarity", shared / F.size(F.array_union("window_shingles", "item_shingles"))).where(F.col("similarity") >= threshold)
    best = F.max_by(F.struct("similarity", "start", "distance"), F.struct("similarity", (-F.col("start")).alias("s"))).alias("b")
    return scored.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.similarity", F.col("b.start").alias("start_word"), F.col("b.distance").cast("int").alias("distance")
    )
