"""Secret scans with a random forest that removes false positives.

Candidates are long runs of key characters inside words. Each gets features: its
length, how its characters change class from one to the next, how much of it
dictionary words cover, what its path says, and which words stand beside it. A
random forest trained on labelled findings then decides.

All of it is DataFrame expressions and Spark's own forest. Candidates leave their
text with a few neighbouring words; texts are never shuffled. The dictionary is the
``DICTIONARY`` most frequent plain words of the whole corpus, the forest sees at most
``LABELLED`` findings (the first by hash of their value); both bounds are fixed
numbers, and all candidates are scored.

Defined cases: null and empty texts have no candidates; a candidate at the end of a
text has an empty neighbour; a null path counts as an empty one; without findings of
both kinds there is no forest and nothing is called a secret; repeated rows give
repeated findings; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.text import let
from shelfmark.llm.common import table, whole, words, written

SHORTEST = 16
CANDIDATE = r"[A-Za-z0-9+/=_-]{16,}"
DICTIONARY, GRAM = 5_000, 4
LABELLED = 20_000
TREES, DEPTH, SEED = 20, 6, 7
KEY_WORDS = r"(?i)token|secret|passw|pwd|api.?key|auth|bearer|credential|private"
TEST_PATH = r"(?i)test|example|sample|mock|fixture|doc"
# Formats of issued keys: what the labelled findings of the check are told by.
ISSUED = r"^(?i:[0-9a-f]{40}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})$"
FEATURES = ("length", "digits", "capitals", "distinct_signs", "letter_digit", "digit_letter", "case_changes", "vowel_changes",
            "coverage", "path_depth", "path_test", "key_word", "assigned", "quoted")


def candidates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, path, at, nth, value, before, near, after): every candidate with the words beside it.

    ``docs`` has ``doc_id``, ``path`` and ``text``; ``at`` is the place of the word, ``nth`` that in the word.
    """

    def seen(w: Column) -> Column:
        word = lambda i: F.coalesce(F.get(w, i), F.lit(""))
        each = F.transform(w, lambda x, i: F.when(F.length(x) >= SHORTEST, F.struct(
            i.alias("at"), x.alias("word"), word(i - 2).alias("before"), word(i - 1).alias("near"), word(i + 1).alias("after"))))
        return F.filter(each, lambda s: s.isNotNull())

    rows = docs.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), F.explode(let(words(whole()), seen)).alias("s")).select("doc_id", "path", "s.*")
    found = rows.select("doc_id", "path", "at", "word", "before", "near", "after", F.posexplode(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))).alias("nth", "value"))
    return found.withColumn("quoted", F.col("word").rlike("[\"'`]").cast("double")).drop("word")


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """Letter sequences of the most frequent plain words of the corpus: (gram), at most ``size`` words' worth."""
    every = docs.select(F.explode(words(whole())).alias("w")).filter(F.col("w").rlike(r"^[A-Za-z]{4,12}$"))
    top = every.groupBy(F.lower("w").alias("w")).count().orderBy(F.desc("count"), "w").limit(size)
    starts = F.sequence(F.lit(1), F.length("w") - (GRAM - 1))
    return top.select(F.explode(F.transform(starts, lambda i: F.substr("w", i, F.lit(GRAM)))).alias("gram")).distinct()


def coverage(values: DataFrame, grams: DataFrame) -> DataFrame:
    """(value, coverage): share of a value's letter sequences that dictionary words have."""
    starts = F.sequence(F.lit(1), F.length("value") - (GRAM - 1))
    each = values.select("value").distinct().select("value", F.explode(F.transform(starts, lambda i: F.substr(F.lower("value"), i, F.lit(GRAM)))).alias("gram"))
    known = F.broadcast(grams.withColumn("known", F.lit(1.0)))
    return each.join(known, "gram", "left").groupBy("value").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("coverage"))


def features(found: DataFrame, grams: DataFrame) -> DataFrame:
    """``found`` with one column per name in ``FEATURES``."""
    value, size = F.col("value"), F.length("value")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    beside = F.concat_ws(" ", "before", "near", "after")
    out = found.join(coverage(found, grams), "value")
    return out.withColumns({
        "length": size.cast("double"), "digits": share("[0-9]"), "capitals": share("[A-Z]"),
        "distinct_signs": F.size(F.array_distinct(F.split("value", ""))) / size,
        "letter_digit": share("(?<=[A-Za-z])[0-9]"), "digit_letter": share("(?<=[0-9])[A-Za-z]"),
        "case_changes": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"), "vowel_changes": share("(?i)(?<=[aeiou])[b-df-hj-np-tv-z]|(?<=[b-df-hj-np-tv-z])[aeiou]"),
        "path_depth": F.regexp_count("path", F.lit("/")).cast("double"), "path_test": F.col("path").rlike(TEST_PATH).cast("double"),
        "key_word": beside.rlike(KEY_WORDS).cast("double"), "assigned": F.col("near").rlike("^[=:]+>?$|[=:]$").cast("double")})


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def train(labelled: DataFrame, limit: int = LABELLED) -> RandomForestClassificationModel | None:
    """A forest from findings with ``label`` 0.0 or 1.0, at most ``limit`` of each kind by hash of the value."""
    kinds = [labelled.filter(F.col("label") == k).dropDuplicates(["value", "label"]).orderBy(F.xxhash64("value"), "value").limit(limit // 2) for k in (0.0, 1.0)]
    if any(k.isEmpty() for k in kinds):
        return None
    rows = assembled(kinds[0].union(kinds[1])).select("features", "label").coalesce(1)  # bounded by ``limit``; one order, one forest
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32).fit(rows)


def score(rows: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """``rows`` with ``probability`` of a secret."""
    if model is None:
        return rows.withColumn("probability", F.lit(0.0))
    judged = model.transform(assembled(rows))
    return judged.withColumn("probability", F.round(vector_to_array("probability")[1], 6)).drop("features", "rawPrediction", "prediction")


def labelled_by_format(rows: DataFrame) -> DataFrame:
    """Labels told by the formats of issued keys, from the value alone."""
    return rows.withColumn("label", F.col("value").rlike(ISSUED).cast("double"))


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every candidate of every document with its probability and verdict."""
    found = written(candidates(docs), "findings")  # small; read by the forest's training and by the verdicts
    rows = written(features(found, dictionary(docs)), "features")
    model = train(labelled_by_format(rows))
    return score(rows, model).withColumn("secret", F.col("probability") >= threshold)


def op2_forest(spark, sf_dir):
    """All candidates of all documents, with the forest's verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), "text")
    return scan(docs).select("doc_id", "at", "nth", F.xxhash64("value").alias("value_hash"), F.length("value").alias("length"), "probability", "secret")
