"""Quality rules: base counts per text, then hashed n-gram log-likelihood ratios.

Two multinomials over hashed n-grams are counted: one over trusted documents, one
over the whole corpus. Each word gives two n-grams, hashed into ranges of their own:
its last three characters, and the whole word without case and punctuation around it.

* ``llr`` is the mean of ``log p(trusted) - log p(corpus)`` over the endings. It
  tells junk from language; below ``threshold`` a document goes.
* Whole words are told apart by ``log((t + f) / (r + f))`` with shares t and r of
  both sides. The same ``f`` on both sides makes rare words neutral and leaves the
  ratios alone when the table grows. A word below ``AVOIDED`` is one that trusted
  documents avoid (abuse, boilerplate); ``n_avoided`` counts them, and a document
  goes when they are over ``MAX_AVOIDED_MILLI`` thousandths of its words. ``f`` is
  ``FLOOR``, or three trusted words' share where that is more: fewer trusted words
  than that can't tell a missing word from a rare one.

Nothing is drawn at random, so equal texts get equal verdicts.

Everything is a DataFrame expression. Texts are never shuffled: the corpus pass
sends at most one row per bucket and task, and the second pass gets one constant
array of ``buckets`` numbers and a bitset of the avoided words' buckets.

Defined cases: a null text counts as empty and fails the base rule; a document
without n-grams scores 0; without a single trusted document all ratios are 0 and
the base rule alone decides; repeated rows get one verdict each; an empty table
gives an empty result; only ``doc_id`` and ``text`` are read,
other columns pass through, and one named like an added column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.text import let
from shelfmark.llm.common import others, pair_up, restored, slim, table, whole, words

NO_SYMBOLS = r"[^#*$%&|<>]+"
BUCKETS = 1 << 14
WORD_BUCKETS = 1 << 18
# At most so many trusted documents (the first by hash of their id) fit the trusted side.
TRUSTED = 20_000
THRESHOLD = -1.0
FLOOR, AVOIDED, MAX_AVOIDED_MILLI = 2e-5, -1.5, 4
AROUND = ".,;:!?\"'()[]"
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30


def covered(windows: Column, span: int = 8) -> Column:
    """Positions under the windows that occur twice or more."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = let(pairs, lambda p: F.filter(p, lambda x, k: F.coalesce(x["h"] == F.get(p, k - 1)["h"], F.lit(False))
                                          | F.coalesce(x["h"] == F.get(p, k + 1)["h"], F.lit(False))))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + F.lit(span) - F.greatest(acc["end"], i)).alias("n"), (i + F.lit(span)).alias("end")))["n"]


def repeated_words(hashes: Column) -> Column:
    """Words that lie in an eight-word window found twice or more; ``hashes`` has one per word.

    Without a repeated four-word window there is no repeated eight-word window, so
    most texts stop early.
    """
    some = lambda h: F.size(F.array_distinct(h)) < F.size(h)
    eight = lambda four: let(pair_up(four, 4), lambda h: F.when(some(h), covered(h)).otherwise(F.lit(0)))
    four = let(pair_up(hashes, 1), lambda two: pair_up(two, 2))
    return let(four, lambda h: F.when(some(h), eight(h)).otherwise(F.lit(0)))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
               lambda x: F.size(x) - F.size(F.array_distinct(x)))


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def ending(word: Column, buckets: int) -> Column:
    """Bucket of a word's last three characters."""
    return bucket(F.substring(word, -3, 3), buckets)


def folded(word: Column) -> Column:
    """Bucket of a whole word without case and the punctuation around it."""
    return bucket(F.lower(F.btrim(word, F.lit(AROUND))), WORD_BUCKETS)


def trusted(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """Ids of documents labelled good and not toxic: at most ``limit`` of them, by hash of the id."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def ratios(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: ``ratios``, the add-one smoothed log ratio of each ending's bucket, and ``avoided``, buckets of avoided words.

    An avoided word has over ``FLOOR * (exp(-AVOIDED) - 1)`` of all words, so there are fewer than 15,000 of them in any corpus.
    """
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted_ids.withColumn("_good", F.lit(1))), "doc_id", "left")
    each = marked.select(F.coalesce("_good", F.lit(0)).alias("good"), F.explode(words(whole())).alias("word"))
    grams = each.select("good", F.explode(F.array(ending(F.col("word"), buckets), folded(F.col("word")) + buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.sum("good").alias("target"), F.count("*").alias("raw"))
    every = docs.sparkSession.range(buckets + WORD_BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").fillna(0, ["target", "raw"])
    is_ending, one = F.col("bucket") < buckets, F.struct("bucket", "target", "raw")
    sums = full.agg(F.sort_array(F.collect_list(F.when(is_ending, one))).alias("endings"),
                    F.collect_list(F.when(~is_ending & (F.col("raw") > 0), one)).alias("words"),
                    F.sum(F.when(is_ending, F.col("target"))).alias("t"), F.sum(F.when(is_ending, F.col("raw"))).alias("r"))
    floor = F.greatest(F.lit(FLOOR), 3 / F.col("t"))

    def ratio(x: Column) -> Column:
        return (F.log((x["target"] + 1) / (F.col("t") + buckets)) - F.log((x["raw"] + 1) / (F.col("r") + buckets)))

    def avoided(x: Column) -> Column:
        return F.log((x["target"] / F.col("t") + F.col("f")) / (x["raw"] / F.col("r") + F.col("f"))) < AVOIDED

    fitted = F.col("t") > 0
    return sums.withColumn("f", F.when(fitted, floor)).select(
        F.transform("endings", lambda x: F.when(fitted, ratio(x)).otherwise(F.lit(0.0))).alias("ratios"),
        F.transform(F.filter("words", lambda x: fitted & avoided(x)), lambda x: x["bucket"] - buckets).alias("avoided"))


def score(word_list: Column, weights: Column, buckets: int = BUCKETS) -> Column:
    """Mean log ratio over the endings of a text; 0 without any."""
    total = F.aggregate(word_list, F.lit(0.0), lambda acc, w: acc + F.get(weights, ending(w, buckets)))
    return F.when(F.size(word_list) == 0, F.lit(0.0)).otherwise(total / F.size(word_list))


def numbers(values: list, kind: str) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def hits(word_list: Column, found: list[int]) -> Column:
    """How many words of a text lie in the buckets ``found``, looked up in a bitset."""
    bits = [0] * (WORD_BUCKETS // 32)
    for b in found:
        bits[b // 32] |= 1 << b % 32
    held = numbers(bits, "bigint")
    inside = lambda b: F.getbit(F.get(held, F.shiftright(b, 5)), b.bitwiseAND(F.lit(31))) == 1
    return F.size(F.filter(F.transform(word_list, folded), inside)) if found else F.lit(0)


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "n_avoided", "base_failed", "kept")


def judge(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``llr``, ``n_avoided`` and ``kept``."""
    fitted = ratios(docs, trusted_ids, buckets).first()  # bounded by the number of buckets, whatever the corpus
    weights = numbers(fitted["ratios"], "double")
    text = whole()
    by_word = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        let(F.transform(w, lambda x: F.xxhash64(x)), repeated_words).cast("long").alias("n_repeat_words"),
        score(w, weights, buckets).alias("llr"), hits(w, fitted["avoided"]).cast("long").alias("n_avoided")))
    by_text = F.struct(F.length(F.regexp_replace(text, NO_SYMBOLS, "")).cast("long").alias("n_symbols"),
                       repeated_lines(text).cast("long").alias("n_dup_lines"))
    found = docs.select(F.struct(*others(docs, *ADDED)).alias("row"), by_word.alias("by_word"), by_text.alias("by_text"))
    out = found.select("row.*", "by_word.*", "by_text.*")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    fluent = (F.col("llr") >= threshold) & (F.col("n_avoided") * 1000 <= F.col("n_words") * MAX_AVOIDED_MILLI)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fluent)


def op4_ngram_llr(spark, sf_dir):
    """Counts and verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, trusted(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr", "n_avoided")


def stage(spark, docs, sf_dir):
    """Pipeline stage: documents that fail the rules go."""
    kept = judge(slim(docs), trusted(table(spark, sf_dir, "labels"))).filter("kept")
    return restored(kept, docs.columns)
