"""Secret scan: candidates by pattern, false positives removed by a random forest.

DataFrame functions and pyspark.ml only. A candidate is a value assigned to a telling name, or a long
run of letters and digits. The forest sees its length, how often kinds of characters change, how much of it is made of
dictionary words, the path of its document and the words beside it, and is trained on labelled findings.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..session import write_once
from .common import text_key

#: Training reads at most so many labelled findings of either label, chosen by a hash.
LABELLED = 2_000
TREES, DEPTH, SEED = 20, 6, 11
CUT = 0.5
#: Characters seen on either side.
BESIDE = 48

NAME = r"""(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)s?+["']?\s{0,3}+[:=]\s{0,3}+["']?"""
ASSIGNED = rf"""{NAME}[^\s"'<>,;]{{6,}}+"""
#: Starts at the start of a run, has a digit, is long.
BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+"
CANDIDATE = f"(?:{ASSIGNED}|{BARE})"
TEST_PATH = r"(?i)(^|[/_.-])(tests?|examples?|samples?|docs?|mocks?|fixtures?)([/_.-]|$)"
DUMMY = r"(?i)example|dummy|sample|placeholder|change.?me|your|xxxx|1234|test|redacted|<|\$\{|\*\*\*"

FEATURES = ["size", "assigned", "quoted", "changes", "digits", "uppers", "lowers", "hexes", "others", "variety", "covered", "dummy", "dummy_beside", "word_before", "word_after", "test_path", "path_depth"]


#: Every fixed finding is one of the forms below; so many of each.
EACH = 100
#: Words that stand around and inside fixed findings.
PLAIN = ("account archive banner branch budget camera center change client cloud column config copper daily detail device draft engine export filter folder garden header image import index invoice "
         "journal kernel layout letter market member meeting module monthly network number office order orange page parser planet policy preview product profile project record region release report "
         "review river sample schedule screen section server session signal status stream summary system table target ticket update user value version weekly window winter").split()


def fixed_findings(spark: SparkSession, each: int = EACH) -> DataFrame:
    """Labelled findings of many forms, the same at every run, made by rule from hashes: the columns of ``candidates`` and label. True: hex, base64 and mixed keys, tokens of known vendors, signed tokens, passwords.
    False: order and card numbers, dates, slugs, paths, identifiers, placeholders, repeated characters, words assigned to a telling name."""
    i = F.col("id")
    digest = lambda k: F.sha2(F.concat(i, F.lit(f":{k}")), 256)
    pick = lambda k, of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(of))) + 1).cast("int"))
    word = lambda k: pick(k, PLAIN)
    mixed = lambda k, n: F.left(F.translate(F.concat(F.base64(F.unhex(digest(k))), F.base64(F.unhex(digest(-k - 1)))), "+/=\r\n", "xYz"), F.lit(n))
    digits = lambda k, n: F.left(F.translate(digest(k), "abcdef", "602759"), F.lit(n))
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = pick("name", ("password", "token", "secret", "api_key", "access_key", "auth", "passwd"))
    to = pick("to", (" = ", "=", ": ", ' = "', ":"))
    year = pick("year", ("2023", "2024", "2025"))
    true = [cat(name, to, F.left(digest(1), F.lit(40))), cat("AKIA", F.upper(F.left(digest(2), F.lit(16)))), cat(name, to, F.left(F.base64(F.unhex(digest(3))), F.lit(40))), cat("ghp_", mixed(4, 36)), cat("sk_live_", mixed(5, 24)),
            cat(name, to, F.initcap(word("p")), digits(6, 2), pick("mark", ("!", "#", "%", "&")), mixed(6, 6)), F.left(F.base64(F.unhex(digest(7))), F.lit(40)), cat("eyJ", mixed(8, 60)), cat(name, to, F.left(digest(9), pick("n", (18, 24, 32)))),
            cat("xoxb-", digits(10, 12), "-", mixed(10, 24)), cat(name, to, mixed(11, 20))]
    false = [cat(word(1), " ", digits(21, 16)), cat(word(1), " ", digits(22, 18)), cat(year, "1128-", word(1), "-", word(2), "-", word(3)), cat(word(1), "-notes-", year, "-11-", word(2)), cat(word(1), "/", word(2), "/", year, "/", word(3), "-01"),
             cat(word(1), "_", word(2), "_", word(3), "_v2"), cat(year, "1128T101500Z-0000"), cat("978-3-16-14841", digits(23, 1), "-", digits(24, 1)), cat(name, to, pick("dummy", ("your-api-key-here", "changeme123", "example-key-1234", "placeholder", "xxxxxxxx1234"))),
             cat(name, to, word(1), "-", word(2), "-", word(3)), cat(name, to, F.repeat(pick("c", ("a", "x", "0", "1")), 24)), cat(name, to, "${", F.upper(word(1)), "_TOKEN}"), cat(name, to, word(1), word(2)), cat(word(1), "-", year, "-", word(2), "-", digits(25, 2))]
    forms = [*true, *false]
    shaped = F.element_at(F.array(*forms), (i % len(forms) + 1).cast("int"))
    text = cat(word("b1"), " ", word("b2"), " ", shaped, pick("end", (" ", '" ', ". ", ", ")), word("a1"), " ", word("a2"))
    docs = spark.range(each * len(forms)).select(i.alias("doc_id"), (i % len(forms) < len(true)).cast("int").alias("_label"), text.alias("text"))
    # one finding of a text: the shaped one stands first
    found = candidates(docs).where("place = 0")
    return found.join(docs.select(F.col("doc_id").alias("_id"), "_label"), F.col("doc_id") == F.col("_id")).select(*found.columns, F.col("_label").alias("label"))


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text_key, place, value, found, before, after, path): every candidate of every whole text. ``path``
    names the column with the document's path; without it, or null, the path is empty."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), F.col("text").alias("_text"), where.alias("path")).where(F.col("_text").rlike(CANDIDATE))
    rows = rows.select("doc_id", "text_key", "path", F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)).alias("m"), F.split("_text", CANDIDATE, -1).alias("s"))
    item = lambda x, i: F.struct(
        i.alias("place"), x.alias("found"), F.right(F.element_at("s", i + 1), F.lit(BESIDE)).alias("before"), F.left(F.element_at("s", i + 2), F.lit(BESIDE)).alias("after"))
    out = rows.select("doc_id", "text_key", "path", F.explode(F.transform("m", item)).alias("c")).select("doc_id", "text_key", "path", "c.*")
    return out.withColumn("value", F.regexp_replace("found", f"^{NAME}(?=.)", ""))


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``found`` with the columns of FEATURES. ``dictionary`` has a column word, in lower case."""
    found = found.withColumn("_n", F.monotonically_increasing_id())
    found = write_once(found, "candidates")
    runs = found.select("_n", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"\p{L}{3,}+"), F.lit(0))).alias("word"))
    words = dictionary.select(F.col("word").alias("word")).where(F.length("word") >= 3).distinct()
    # counted per candidate and run first, so that a value repeated in many documents is looked up in one shuffle
    covered = runs.join(words, "word", "left_semi").groupBy("_n").agg(F.sum(F.length("word")).alias("letters"))
    change = r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"
    word = r"^\p{L}{2,}$"
    return found.join(covered, "_n", "left").select(
        "*", F.length("value").cast("double").alias("size"), F.col("found").rlike(f"^{NAME}").cast("double").alias("assigned"),
        (F.right("before", F.lit(1)).isin('"', "'") | F.col("found").rlike(r"""["']""")).cast("double").alias("quoted"),
        _share(change).alias("changes"), _share("[0-9]").alias("digits"), _share("[A-Z]").alias("uppers"), _share("[a-z]").alias("lowers"), _share("[0-9a-f]").alias("hexes"),
        _share("[^A-Za-z0-9]").alias("others"), (F.size(F.array_distinct(F.split("value", ""))) / F.length("value")).alias("variety"),
        (F.coalesce("letters", F.lit(0)) / F.length("value")).alias("covered"), F.col("value").rlike(DUMMY).cast("double").alias("dummy"),
        (F.col("before").rlike(DUMMY) | F.col("after").rlike(DUMMY)).cast("double").alias("dummy_beside"),
        F.regexp_extract("before", r"(\S*)\s*$", 1).rlike(word).cast("double").alias("word_before"), F.regexp_extract("after", r"^\s*(\S*)", 1).rlike(word).cast("double").alias("word_after"),
        F.col("path").rlike(TEST_PATH).cast("double").alias("test_path"), F.size(F.split("path", "/")).cast("double").alias("path_depth"),
    ).drop("_n", "letters")


def bounded(labelled: DataFrame, most: int = LABELLED) -> DataFrame:
    """At most ``most`` rows of each label, the same ones at every run."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("found", "before"), "found", "before", "after")
    return labelled.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def train(labelled: DataFrame, dictionary: DataFrame, most: int = LABELLED) -> PipelineModel:
    """A forest from labelled findings (the columns of ``candidates`` and label, 1: a secret; at most ``most`` of either label) and the fixed ones, so there is a forest for every corpus."""
    some = bounded(labelled.where(F.col("label").isin(0, 1)), most)
    both = some.select(*[c for c in some.columns if c in ("doc_id", "text_key", "place", "found", "before", "after", "path", "value", "label")]).unionByName(fixed_findings(labelled.sparkSession))
    rows = write_once(features(both, dictionary).select("label", *FEATURES), "labelled")
    shape = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_is")
    return PipelineModel([shape, forest.fit(shape.transform(rows))])


def held_out_quality(labelled: DataFrame, dictionary: DataFrame, cut: float = CUT) -> DataFrame:
    """(n, precision, recall) on a fifth of ``labelled``, chosen by a hash, of a forest that has seen the rest."""
    fifth = F.pmod(F.xxhash64("found", "before"), F.lit(5)) == 0
    rows = write_once(features(labelled, dictionary), "judged")
    shape = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_is")
    told = forest.fit(shape.transform(rows.where(~fifth))).transform(shape.transform(rows.where(fifth))).select("label", (F.element_at(vector_to_array("_p"), 2) >= cut).alias("secret"))
    hit = F.count_if(F.col("secret") & (F.col("label") == 1))
    return told.agg(F.count("*").alias("n"), (hit / F.count_if("secret")).alias("precision"), (hit / F.count_if(F.col("label") == 1)).alias("recall"))


def judged(found: DataFrame, dictionary: DataFrame, model: PipelineModel, cut: float = CUT) -> DataFrame:
    """(doc_id, text_key, place, found, value, score, secret) for every candidate."""
    rows = features(found, dictionary)
    keep = ["doc_id", "text_key", "place", "found", "value"]
    scored = model.transform(rows).withColumn("score", F.element_at(vector_to_array("_p"), 2))
    return scored.select(*keep, "score", (F.col("score") >= cut).alias("secret"))


def labelled_findings(found: DataFrame) -> DataFrame:
    """Labelled findings from candidates themselves. True: candidates of a strict known form. False: numbers alone, and decoys put in
    the place of true ones (the same surroundings, but a value of words beside it, of one repeated character, or a placeholder)."""
    strict = (F.col("value").rlike("^AKIA[0-9A-Z]{16}$") | (F.col("found").rlike(f"^{NAME}") & F.col("value").rlike("^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,}$")))
    dull = F.col("value").rlike(r"^[0-9/_=+-]*$|^\p{L}*$")
    real = found.where(strict).withColumn("label", F.lit(1))
    other = found.where(~strict & dull).withColumn("label", F.lit(0))
    kind = F.pmod(F.xxhash64("found", "before"), F.lit(3))
    beside = F.regexp_replace(F.concat_ws("-", F.regexp_extract("before", r"(\p{L}*)\P{L}*$", 1), F.regexp_extract("after", r"^\P{L}*(\p{L}*)", 1)), "^-$", "some-words")
    fake = F.when(kind == 0, F.concat(beside, F.lit("-words"))).when(kind == 1, F.repeat(F.left("value", F.lit(1)), F.length("value"))).otherwise(F.lit("your-example-key-here-1234"))
    decoys = real.withColumn("_fake", fake).withColumn("found", F.concat(F.substring(F.col("found"), F.lit(1), F.length("found") - F.length("value")), F.col("_fake"))).withColumn("value", F.col("_fake")).drop("_fake").withColumn("label", F.lit(0))
    return real.unionByName(other).unionByName(decoys)


def dictionary(*texts: DataFrame) -> DataFrame:
    """Every word (of letters, lower case) of the given text columns."""
    split = [t.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\P{L}++")).alias("word")).where("word <> ''") for t in texts]
    out = split[0]
    for s in split[1:]:
        out = out.union(s)
    return out.distinct()


def scan(docs: DataFrame, words: DataFrame, labelled: DataFrame | None = None, path: str | None = None, cut: float = CUT) -> DataFrame:
    """(doc_id, text_key, place, found, value, score, secret) for every candidate of every row of ``docs``; place counts from 0.
    Without ``labelled`` findings, those of ``labelled_findings`` are used. The texts are read once.

    A null or empty text has no candidate; repeated rows are scanned each; a null doc_id stays;
    very long texts are read whole; other columns are not read. Fixed findings of many forms are always learned from, too.
    """
    words = write_once(words, "dictionary")
    found = write_once(candidates(docs, path), "found")
    model = train(labelled_findings(found) if labelled is None else labelled, words)
    return judged(found, words, model, cut)


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret value replaced where it was found, and n_chars, where there is one, counted anew. Rows and columns stay; the same word elsewhere in the
    text stays; null and empty texts have nothing to replace; repeated rows are changed alike."""
    places = write_once(found.where("secret").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text_key")).agg(F.collect_set("place").alias("__places")), "secrets")
    rows = docs.withColumn("__key", text_key())
    both = rows.join(places, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text_key")), "left")
    # the text is cut at its candidates again and put together: n + 1 pieces around n candidates
    at, between = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), F.split("text", CANDIDATE, -1)
    new = F.transform(at, lambda x, i: F.when(F.array_contains("__places", i), F.concat(F.regexp_extract(x, f"^{NAME}(?=.)", 0), F.lit(mark))).otherwise(x))
    whole = F.array_join(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    out = both.withColumn("text", F.when(F.col("__places").isNull(), F.col("text")).otherwise(whole))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__places").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "place", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.length("value").alias("n_chars"), "score", "secret")
