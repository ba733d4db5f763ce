"""Quality rules: simple counts, and divergence of a document from language references.

A document's histograms of character classes and of common words are compared with those of each language by
Jensen-Shannon distance (base 2, square root of the divergence). The references are the counts of all documents that
carry the language. A document is kept if it passes the base rules and at least one language is near in both
histograms; each comparison needs a minimum length and is passed over below it. All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationloom.llm.common import WORD, stored, text_of, words_of

WINDOW = 5
CLASSES = {"_symbol": r"[#*$%&|<>]", "_digit": r"[0-9]", "_upper": r"[A-Z]", "_point": r"[.,;:!?'\"()\[\]/-]",
           "_foreign": r"[^\x00-\x7F]"}


@dataclass(frozen=True)
class Limits:
    char_distance: float = 0.25    # Jensen-Shannon distances above these are far
    word_distance: float = 0.36    # a text without a common word is 0.38 away where those cover 26 % of a language
    char_words: int = 30           # fewer words than this: no comparison of characters
    word_words: int = 60           # fewer words than this: no comparison of words
    common: int = 40               # words of a language's reference
    common_chars: int = 5          # common words are short: longer ones are not counted


def _repeat_words(words: str, hashes: str) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, every occurrence included."""
    count = F.size(hashes) - WINDOW + 1
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(
        F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return F.when(count > 0, windows).otherwise(none)


def base_features(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts per row, the words and the characters of each class. One row out per row in."""
    t = text_of(text)
    split = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), t.alias("_text"),
                        words_of(t).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.rlike(line, F.lit(WORD)))
    counted = split.select(
        "_key", "_lang", "_words", F.size("_words").cast("bigint").alias("n_words"),
        F.char_length("_text").cast("bigint").alias("_chars"),
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        *[F.regexp_count("_text", F.lit(rule)).cast("bigint").alias(c) for c, rule in CLASSES.items()],
        lines.alias("_lines"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    windowed = counted.select(
        "*", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words("_words", "_hashes").alias("_windows")).drop("_lines", "_hashes")
    repeated = F.size(F.array_distinct(F.transform("_windows", lambda w: w["h"]))) < F.size("_windows")
    ordered = windowed.select("*", F.when(repeated, F.array_sort("_windows")).alias("_sorted")).drop("_windows")

    def same_words(a: Column, b: Column) -> Column:
        # equal hashes are checked word by word
        return (a["h"] == b["h"]) & (F.slice("_words", a["i"] + 1, WINDOW) == F.slice("_words", b["i"] + 1, WINDOW))

    def twin(w: Column, j: Column) -> Column:
        before, after = F.get("_sorted", j - 1), F.get("_sorted", j + 1)
        return F.coalesce(same_words(before, w), F.lit(False)) | F.coalesce(same_words(w, after), F.lit(False))

    starts = F.sort_array(F.transform(F.filter("_sorted", twin), lambda w: w["i"]))
    found = ordered.select("*", starts.alias("_starts")).drop("_sorted")
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("_starts") - 1), F.lit(0),
        lambda n, j: n + F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - F.get("_starts", j), F.lit(WINDOW))))
    return found.select("*", F.when(F.size("_starts") > 0, covered).otherwise(0).cast("bigint").alias(
        "n_repeat_words")).drop("_starts").withColumnRenamed("_symbol", "n_symbols")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def common_words(docs: DataFrame, limits: Limits, text: str = "text", lang: str = "lang") -> DataFrame:
    """``_lang, _word, _n``: the commonest short words of each language over all documents, ties by the word."""
    short = F.filter(F.split(text_of(text), r"[\x20\x09-\x0D]+"),
                     lambda w: (F.octet_length(w) <= 4 * limits.common_chars) & (F.char_length(w) <= limits.common_chars)
                     & (w != ""))
    counts = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("_lang"), F.explode(short).alias(
        "_word")).groupBy("_lang", "_word").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("_n"), "_word"))
    return counts.select("*", rank.alias("_rank")).where(F.col("_rank") <= limits.common).drop("_rank")


def _term(p: Column, q: Column) -> Column:
    """A bin's share of the Jensen-Shannon divergence."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) / 2 + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0) / 2


def _runs(words: str) -> Column:
    """``struct(word, n)`` of each different word of a sorted array."""
    ends = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i + 1 == F.size(words)) | (
        F.get(words, i) != F.get(words, i + 1)))
    return F.when(F.size(words) > 0, ends)


def divergences(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text",
                lang: str = "lang") -> DataFrame:
    """Base counts plus ``char_distance``, ``word_distance`` to the language that fits best, and ``fits``.

    Distances are NULL where the text is too short to compare or no language is known; then nothing is held against
    the document.
    """
    top = common_words(docs, limits, text, lang).collect()        # at most `common` rows for each language
    vocabulary = sorted({r["_word"] for r in top})
    features = base_features(docs, key, text, lang)
    hits = F.filter("_words", lambda w: w.isin(vocabulary)) if vocabulary else F.array().cast("array<string>")
    sorted_hits = features.select("*", F.sort_array(hits).alias("_hits")).drop("_words")
    ended = sorted_hits.select("*", _runs("_hits").alias("_ends"))
    runs = F.transform("_ends", lambda e, j: F.struct(F.get("_hits", e).alias("word"), (
        e - F.coalesce(F.get("_ends", j - 1), F.lit(-1))).alias("n")))
    table = stored(ended.select("*", F.coalesce(runs, F.array().cast("array<struct<word:string,n:int>>")).alias(
        "_runs")).drop("_hits", "_ends"))

    classes = ["n_symbols", "_digit", "_upper", "_point", "_foreign", "_gap", "_plain"]
    table = table.withColumn("_gap", F.col("_chars") - F.col("word_chars")).withColumn(
        "_plain", F.greatest(F.col("_chars") - sum((F.col(c) for c in classes[:-1]), F.lit(0)), F.lit(0)))
    sums = table.where(F.col("_lang").isNotNull()).groupBy("_lang").agg(
        F.sum("n_words").alias("_n"), *[F.sum(c).alias(c) for c in classes])
    # every language has a reference: some 50 numbers each, however many documents it has
    refs = [r for r in sums.orderBy(F.desc("_n"), "_lang").collect() if r["_n"] > 0]
    counted = table.withColumn("base_failed", base_failed())
    if not refs:
        empty = F.lit(None).cast("double")
        return counted.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                              "n_repeat_words", "base_failed", empty.alias("char_distance"),
                              empty.alias("word_distance"), F.lit(True).alias("fits"))

    number = {r["_lang"]: k for k, r in enumerate(refs)}
    holders: dict[str, list[tuple[int, float]]] = {w: [] for w in vocabulary}
    known = [0.0] * len(refs)
    for r in top:
        k = number[r["_lang"]]
        holders[r["_word"]].append((k, r["_n"] / refs[k]["_n"]))
        known[k] += r["_n"] / refs[k]["_n"]

    def doubles(values: list[float]) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    each = F.array(*[F.struct(
        F.lit(k).alias("k"), doubles([r[c] / sum(r[x] for x in classes) for c in classes]).alias("chars"),
        F.lit(max(0.0, 1 - known[k])).alias("other"), F.lit(known[k]).alias("known")) for k, r in enumerate(refs)])
    total = sum((F.col(c) for c in classes), F.lit(0))
    measured = counted.withColumns({f"_p{c}": F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)) for c in classes})
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q"))
    if vocabulary:
        # a word adds half its share to the distance from a language that does not list it; entries correct that
        lookup = F.create_map(*[x for w, held in holders.items() for x in (F.lit(w), F.array(*[
            F.struct(F.lit(k).alias("k"), F.lit(q).alias("q")) for k, q in held]))])
        entries = F.flatten(F.transform("_runs", lambda r: F.transform(F.element_at(lookup, r["word"]), lambda h: F.struct(
            h["k"].alias("k"), h["q"].alias("q"),
            (_term(r["n"] / F.col("n_words"), h["q"]) - r["n"] / F.col("n_words") / 2).alias("d")))))
        seen = F.aggregate("_runs", F.lit(0.0), lambda a, r: a + r["n"] / F.col("n_words"))
        measured = measured.withColumns({"_entries": entries, "_seen": seen})

    def word_distance(ref: Column) -> Column:
        if not vocabulary:
            return F.lit(0.0)
        own = F.aggregate("_entries", zero, lambda a, e: F.when(e["k"] == ref["k"], F.struct(
            (a["d"] + e["d"]).alias("d"), (a["q"] + e["q"]).alias("q"))).otherwise(a))
        return F.transform(F.array(own), lambda a: F.sqrt(F.greatest(
            F.col("_seen") / 2 + a["d"] + _term(F.greatest(1 - F.col("_seen"), F.lit(0.0)), ref["other"])
            + F.greatest(ref["known"] - a["q"], F.lit(0.0)) / 2, F.lit(0.0))))[0]

    measured = measured.withColumn("_d", F.transform(each, lambda ref: F.struct(
        F.sqrt(F.greatest(sum((_term(F.col(f"_p{c}"), F.get(ref["chars"], F.lit(j))) for j, c in enumerate(classes)),
                              F.lit(0.0)), F.lit(0.0))).alias("c"), word_distance(ref).alias("w"))))
    by_char, by_word = F.col("n_words") >= limits.char_words, F.col("n_words") >= limits.word_words

    def fit(d: Column) -> Column:
        return (~by_char | (d["c"] <= limits.char_distance)) & (~by_word | (d["w"] <= limits.word_distance))

    best = F.array_min(F.transform("_d", lambda d: F.struct((d["c"] + d["w"]).alias("sum"), d["c"].alias("c"),
                                                            d["w"].alias("w"))))
    return measured.select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(by_char, best["c"]).alias("char_distance"), F.when(by_word, best["w"]).alias("word_distance"),
        (F.exists("_d", fit) | ~by_char).alias("fits"))


def judge(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text",
          lang: str = "lang") -> DataFrame:
    """``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ...`` per row.

    NULL text has no words and so fails the base rules. Rows without a language are judged like others but do not
    enter a reference. Repeated rows are judged each; an empty table gives no rows.
    """
    out = divergences(docs, limits, key, text, lang)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("fits")).drop("fits").withColumns(
        {c: F.round(c, 4) for c in ("char_distance", "word_distance")})


def keep_good(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text",
              lang: str = "lang") -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns. Rows equal in key, language and text share a verdict."""
    ident = F.struct(F.col(key).alias("key"), F.col(lang).alias("lang"), F.xxhash64(text_of(text)).alias("print"))
    good = judge(docs.select(ident.alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")), limits,
                 "id", "text", "lang").where("kept").select(F.col("id").alias("_good")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), ident.alias("_id"))
    return rows.join(good, F.col("_id") == F.col("_good"), "left_semi").select("_row.*")
