"""Quality by distribution divergence, in DataFrame expressions.

A document's histograms of character classes and of common words are compared with those of its language, which are
counted over all other documents. The Jensen-Shannon distance (base 2, 0 to 1) says how far they are apart. Documents too
short for a histogram to mean anything aren't judged by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, cut, let

# Character classes, as regular expressions; what none of them takes is the class of other ASCII (mostly small letters).
CLASSES = {
    "spaces": r"[\x20\x09-\x0D]", "capitals": "[A-Z]", "digits": "[0-9]", "symbols": r"[#*$%&|<>]",
    "marks": r"""[!"'()+,\-./:;=?@\[\\\]^_`{}~]""", "beyond": r"[^\x00-\x7F]",
}


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts, each scaled to sum one; null if either sums to nothing."""

    def divergence(pair: Column) -> Column:
        half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
        terms = F.zip_with(pair["p"], pair["q"], lambda x, y: half(x, y) + half(y, x))
        total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2
        return F.sqrt(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))

    def scaled(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return F.when(total > 0, let(total, lambda t: F.transform(counts, lambda x: x / t)))

    pair = F.struct(scaled(p).alias("p"), scaled(q).alias("q"))
    return let(pair, lambda s: F.when(s["p"].isNotNull() & s["q"].isNotNull(), divergence(s)))


def total(counts: str) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)


def repeated_words(ws: Column) -> Column:
    """How many words lie in a window of three words that the text has twice or more, by the windows' 64-bit hashes."""
    n = F.size(ws)
    hashes = F.transform(F.slice(ws, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = lambda s: F.filter(
            F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"]), e["i"])), lambda i: i.isNotNull()
        )
        width = lambda at: F.transform(at, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - i, F.lit(3))))
        return let(by_hash, lambda s: let(F.sort_array(twice(s)), lambda at: F.aggregate(width(at), F.lit(0), lambda a, b: a + b)))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def common_words(docs: DataFrame, n_common: int, most_letters: int) -> dict[str, list[str]]:
    """Each language's ``n_common`` most frequent words of up to ``most_letters`` letters, over all documents (small letters)."""
    words = docs.select("lang", F.explode(F.split(F.lower("text"), SPACE_PATTERN)).alias("word")).where((F.length("word") <= most_letters) & F.col("word").rlike(r"^\p{L}+$"))
    counts = words.groupBy("lang", "word").count()
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = counts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n_common)
    out: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "nth").collect():  # n_common rows a language
        out.setdefault(r["lang"], []).append(r["word"])
    return out


def measure(docs: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """doc_id, lang, the contract's counts, and the histograms ``classes`` and ``commons``, of docs (doc_id, lang, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ws = F.filter(F.split(text, SPACE_PATTERN), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", "lang", "text", ws.alias("ws"), lines.alias("lines"), *(F.regexp_count(text, F.lit(p)).cast("bigint").alias(c) for c, p in CLASSES.items()), F.length(text).cast("bigint").alias("length"))
    rest = F.col("length") - reduce(lambda a, b: a + b, map(F.col, CLASSES))
    listed = reduce(lambda acc, x: acc.when(F.col("lang") == x[0], F.array(*map(F.lit, x[1]))), common.items(), F.when(F.lit(False), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    # numbers of common words in the text, 0 for all others
    numbers = let(listed, lambda c: F.transform("ws", lambda w: F.array_position(c, F.lower(w)).cast("int")))
    most = max(map(len, common.values()), default=0)
    commons = let(numbers, lambda at: F.concat(
        F.array(F.size(F.filter(at, lambda x: x == 0)).cast("double")),
        let(F.filter(at, lambda x: x > 0), lambda some: F.transform(F.sequence(F.lit(1), F.lit(max(most, 1))), lambda k: F.size(F.filter(some, lambda x: x == k)).cast("double"))),
    ))
    return rows.select(
        "doc_id", "lang", F.size("ws").cast("bigint").alias("n_words"), (F.col("length") - F.col("spaces")).alias("word_chars"), F.col("symbols").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), repeated_words(F.col("ws")).cast("bigint").alias("n_repeat_words"),
        F.array(*(F.col(c).cast("double") for c in CLASSES), rest.cast("double")).alias("classes"), commons.alias("commons"),
    )


def judge_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n_common: int = 16, most_letters: int = 6,
    most_class_distance: float = 0.25, most_word_distance: float = 0.27, least_chars: int = 200, least_words: int = 100,
    least_reference: int = 1000,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept.

    kept: not base_failed, and neither histogram is too far from its language's: character classes where a document has
    ``least_chars`` characters, common words (and all others as one) where it has ``least_words`` words.

    References are sums over all documents of a language less the judged one; a null language counts as one. A language
    whose other documents hold fewer than ``least_reference`` words is no reference: character classes are then compared
    with those of the other documents of all languages, common words aren't judged (word_distance is null). Where these
    are too few as well, both distances are null and kept is what the base says.

    The texts are read twice, for the common words and for the measures; shuffled are partial counts of short words,
    never texts.

    Null and blank texts have no words and fail by the base. Distances are null where a histogram is empty, too. Null ids and
    repeated rows are kept as they are. Empty table: no rows. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    common = common_words(docs, n_common, most_letters)
    measured = cut(measure(docs, common))
    sizes = {"classes": len(CLASSES) + 1, "commons": max([1, *map(len, common.values())]) + 1}
    sums = [F.array(*(F.sum(F.col(c)[i]) for i in range(n))).alias(f"all_{c}") for c, n in sizes.items()]
    by_lang = cut(measured.groupBy("lang").agg(*sums))  # a row a language
    everywhere = by_lang.agg(*(F.sum(F.col("all_classes")[i]) for i in range(sizes["classes"])), F.sum(total("all_commons"))).first()
    all_classes, all_words = F.array(*(F.lit(x) for x in everywhere[:-1])), F.lit(everywhere[-1]) - F.col("n_words")
    others = lambda everyone, own: F.zip_with(everyone, own, lambda x, y: x - y)
    own_lang = total("all_commons") - F.col("n_words") >= least_reference
    class_reference = F.when(own_lang, F.col("all_classes")).when(all_words >= least_reference, all_classes)
    distances = measured.join(F.broadcast(by_lang), "lang").select(
        "*", js_distance(F.col("classes"), others(class_reference, F.col("classes"))).alias("class_distance"),
        F.when(own_lang, js_distance(F.col("commons"), others(F.col("all_commons"), F.col("commons")))).alias("word_distance"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    chars = total("classes")
    far = ((chars >= least_chars) & (F.col("class_distance") > most_class_distance)) | ((F.col("n_words") >= least_words) & (F.col("word_distance") > most_word_distance))
    return distances.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        "class_distance", "word_distance", (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"),
    )
