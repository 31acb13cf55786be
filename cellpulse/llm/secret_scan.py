"""Secret scan: pattern candidates, and a random forest that removes false positives.

Candidates are private-key blocks, values assigned to credential words, and
long tokens with a digit, each of them whole, however long it is. Each is described by its length, its changes between
letters, digits and marks, how much of it dictionary words cover, whether it looks like a
path, and the words beside it. Findings whose surroundings or format leave no
doubt are labelled by fixed rules; a bounded sample of them, with a few
generated ones so that both classes always exist, trains the forest, which
judges every candidate.

Only DataFrame functions and Spark's own forest: no Python on the executors.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellpulse.llm.common import fresh, written

#: Characters of a token; '=' only pads its end, so that a value after '=' or ':' starts a token of its own.
TOKEN = r"A-Za-z0-9_+/\-"
#: A private key: all up to its END or, if that is missing, all lines that may be of a key. Repetitions are possessive,
#: so that long values need neither stack nor second tries.
KEY_HEADER = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
KEY_LINE = (r"(?:[A-Za-z0-9+/]{16,}+=*+|[A-Za-z0-9+/]++=*+(?=\h*+(?:[\r\n]|\z)|\\[nr]|[\"'])"
            r"|(?:Proc-Type|DEK-Info|Version|Comment):[^\r\n]*+)")
KEY = (rf"{KEY_HEADER}(?:(?:[^\-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{{0,30}}PRIVATE KEY-----"
       rf"|(?:(?:\s|\\[nr]|[\"',>#*])*+{KEY_LINE})*+)")
#: Formats that providers publish, also inside a token (fixed values). A signed token goes to the end of its last part.
FORMATS = (r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abps]-[A-Za-z0-9\-]{10,}+"
           r"|AIza[A-Za-z0-9_\-]{35}(?![A-Za-z0-9_\-])|sk_live_[A-Za-z0-9]{16,}+"
           r"|eyJ[A-Za-z0-9_\-]{10,}+(?:\.{1,2}[A-Za-z0-9_\-]++)*+)")
PUBLISHED = rf"{KEY_HEADER}|{FORMATS}"
#: Ends of names to which secrets are assigned (fixed list), and such a name up to the start of the value.
NAMES = (r"(?i:password|passwd|passphrase|pwd|secret|token|(?:api|access|secret|private|auth)[_\-]?key)")
LEAD = (rf"[{TOKEN}]++(?=\\?[\"']?\h*+[:=])(?<={NAMES})\\?[\"']?\h*+[:=]{{1,2}}+>?+\h*+(?:\\?[\"'])?+")
#: A value goes up to its own closing quote or white space. Without quotes, marks that end a clause are not its last
#: characters, and the next parameter of a query string is not part of it.
VALUE = (r"(?!-----BEGIN )(?:(?<=(?<!\\)\")(?:[^\s\"\\]|\\\S){6,}+|(?<=(?<!\\)')(?:[^\s'\\]|\\\S){6,}+"
         r"|(?<!(?<!\\)[\"'])(?=[^\s\"'<>]{6})"
         r"(?:[^\s\"'<>&\\.,;:)\]}]|\\(?![\"'])|&(?![A-Za-z0-9_.\-]+=)|[.,;:)\]}]++(?=[^\s\"'<>\\]))++)")
#: What may be a secret: fixed pattern. A token ends before a published format inside it and may start after one.
CANDIDATE = (rf"{KEY}|{FORMATS}|(?<![{TOKEN}]){LEAD}{VALUE}"
             rf"|(?:(?<![{TOKEN}])|\G)(?=[A-Za-z_+/\-]*+[0-9])(?:(?!{FORMATS})[{TOKEN}]){{16,}}+(?:={{1,2}}+(?![{TOKEN}=]))?+")
#: Words before a secret, and before other long tokens (fixed lists).
CUES = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential",
        "credentials", "private", "access_key", "client_secret")
OTHER = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "etag", "uuid", "guid", "id", "version",
         "build", "isbn", "order", "invoice", "card", "phone", "serial", "integrity", "revision")
#: Words that names, paths and placeholders are made of (fixed list).
DICTIONARY = ("example", "sample", "placeholder", "changeme", "redacted", "dummy", "test", "user", "name", "file", "path",
              "config", "data", "image", "index", "page", "home", "main", "source", "public", "static", "assets", "http",
              "www", "com", "org", "net", "html", "json", "version", "build", "release", "default", "value", "number",
              "value", "class", "function", "method", "module", "package", "library", "service", "client", "server",
              "the", "and", "for", "with", "from", "that", "this", "your", "insert", "here", "none", "null", "true", "false")
FEATURES = ("length", "transitions", "digits", "upper", "marks", "hex", "distinct", "dictionary", "path", "cue", "other",
            "assigned", "quoted", "published")
#: Findings that train the forest, at most, from either class.
TRAINING_FINDINGS = 10_000
TREES, DEPTH, SEED = 24, 6, 17
#: Characters before a candidate that are looked at, and what replaces a secret.
BESIDE = 48
MASK = "[SECRET]"


def found_in(text: Column) -> Column:
    """Array of the candidates: ``lead``, the name and sign of an assignment, and the ``value`` after it."""
    return F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda found: F.struct(
        F.regexp_extract(found, f"^{LEAD}", 0).alias("lead"), F.regexp_replace(found, f"^{LEAD}", "").alias("value")))


def _share(value: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{chars}]", "")) / F.length(value)


def described(findings: DataFrame) -> DataFrame:
    """Feature columns (doubles) from ``value`` and the text ``before`` and ``after`` it."""
    v, before = F.col("value"), F.col("before")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    runs = F.regexp_replace(F.regexp_replace(classes, "[^aA9]", "-"), r"(.)\1+", "$1")
    words = F.array_remove(F.split(F.lower(before), r"[^a-z0-9_]+"), "")
    last = F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))

    def near(listed: tuple[str, ...]) -> Column:
        return F.arrays_overlap(last, F.array(*map(F.lit, listed)))

    covered = F.length(F.regexp_replace(F.lower(v), "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))), ""))
    columns = {
        "length": F.length(v),
        "transitions": (F.length(runs) - 1) / F.greatest(F.length(v) - 1, F.lit(1)),
        "digits": _share(v, "0-9"), "upper": _share(v, "A-Z"), "marks": 1 - _share(v, "A-Za-z0-9"),
        "hex": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "distinct": F.size(F.array_distinct(F.split(F.substring(v, 1, 64), ""))) / F.least(F.length(v), F.lit(64)),
        "dictionary": 1 - covered / F.length(v),
        "path": before.rlike(r"[/\\.]$") | v.rlike("/[a-z]+/") | F.col("after").rlike(r"^\.[a-z]{2,4}\b"),
        "cue": near(CUES) | before.rlike(f"{LEAD}$"), "other": near(OTHER),
        "assigned": before.rlike(r"[:=]>?\s*\\?[\"']?$"), "quoted": before.rlike(r"[\"']$"),
        "published": v.rlike(PUBLISHED),
    }
    return findings.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in columns.items()})


def rule_label() -> Column:
    """1 or 0 where format and surroundings leave no doubt, else null."""
    random = (F.col("distinct") > 0.15) & (F.col("dictionary") < 0.3)
    sure = (F.col("published") == 1) | ((F.col("cue") == 1) & (F.col("assigned") == 1) & (F.col("length") >= 12)
                                        & (F.col("digits") < 1) & (F.col("digits") > 0.05) & random)
    word = (F.col("digits") == 0) & (F.col("quoted") == 0)
    not_one = word | ((F.col("digits") == 1) & (F.col("cue") == 0)) | (F.col("dictionary") > 0.5) | (F.col("other") == 1) | (
        (F.col("path") == 1) & (F.col("cue") == 0))
    return F.when(sure, 1.0).when(not_one, 0.0)


def _generated(spark: SparkSession) -> DataFrame:
    """A few labelled findings of each kind, made by rule: the forest always sees both classes."""
    n = F.col("id").cast("string")
    kinds = [
        (F.sha1(n), 'token = "', '"'), (F.upper(F.md5(n)), "secret: ", "\n"),
        (F.regexp_replace(F.base64(F.unhex(F.sha2(n, 256))), "=+$", ""), "api_key='", "'"),
        (F.concat(F.lit("1000"), F.substring(F.conv(F.substring(F.md5(n), 1, 14), 16, 10), 1, 12)), "call the ", " now"),
        (F.concat(F.lit("static/assets/page"), n, F.lit("index")), "see /", ".html"),
        (F.sha1(n), "commit ", " fixed"), (F.concat(F.lit("example_value_for_test"), n), 'name = "', '"'),
    ]
    short = F.substring(F.base64(F.unhex(F.sha2(n, 256))), 1, 7)
    kinds += [
        (F.concat(short, F.lit("!7pass")), 'PASSWORD = "', '"'), (F.concat(short, F.lit("5x")), '{"password": "', '"'),
        (F.concat(F.lower(short), F.lit("2x")), "password: ", "\n"), (F.concat(F.lit("hill"), F.substring(F.conv(F.substring(F.md5(n), 1, 8), 16, 10), 1, 2), F.lit("er")), "pwd=", "\n"),
        (F.translate(F.substring(F.md5(n), 1, 8), "0123456789", "ghijklmnop"), "the token: ", " "),
        (F.translate(F.substring(F.md5(n), 1, 11), "0123456789", "ghijklmnop"), "secret = ", "("),
    ]
    secret = (0, 1, 2, 7, 8, 9, 10)
    rows = [spark.range(40).select(v.alias("value"), F.lit(b).alias("before"), F.lit(a).alias("after"),
                                   F.lit(1.0 if i in secret else 0.0).alias("label")) for i, (v, b, a) in enumerate(kinds)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return described(out).select(*FEATURES, "label")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, k, start, end, kind, value, features): every candidate of every distinct (id, text)."""
    text = F.col(text_col).cast("string")
    rows = (docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
            .where(F.col("text").rlike(CANDIDATE))
            .select("doc_id", F.xxhash64("text").alias("h"), found_in(F.col("text")).alias("found"),
                    F.split("text", CANDIDATE).alias("parts"), F.length("text").alias("n")))
    gap = F.concat(F.element_at("parts", F.col("k") + 1), "item.lead")
    each = rows.select("doc_id", "h", "parts", F.posexplode("found").alias("k", "item")).select(
        "doc_id", "h", "k", "item.value", F.right(gap, F.lit(BESIDE)).alias("before"),
        F.left(F.element_at("parts", F.col("k") + 2), F.lit(BESIDE)).alias("after"), F.length(gap).alias("gap"))
    each = described(each.dropDuplicates(["doc_id", "h", "k"]))
    upto = W.partitionBy("doc_id", "h").orderBy("k")
    end = F.sum(F.col("gap") + F.length("value")).over(upto)
    kind = F.when(F.col("value").startswith("-----BEGIN"), "private_key").when(F.col("published") == 1, "provider_token").when(
        F.col("assigned") == 1, "assigned").otherwise("token")
    return each.withColumns({"end": end, "kind": kind}).withColumn("start", F.col("end") - F.length("value"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         training_findings: int = TRAINING_FINDINGS) -> DataFrame:
    """Every candidate with the forest's judgement.

    Returns ``doc_id``, ``h`` (hash of the text), ``k`` (number within the
    text), ``start``, ``end`` (code points, end exclusive), ``kind``,
    ``value_sha256``, ``probability`` and ``secret``. Null and empty texts
    have no candidates. Null ids pass through; rows that repeat id and text
    give one set of findings; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    all_found = written(candidates(docs, id_col, text_col), "findings")
    labelled = all_found.withColumn("label", rule_label()).where("label is not null").select(
        *FEATURES, "label", F.xxhash64("value", "before", "after").alias("o"))
    train = _generated(spark)
    for label in (1.0, 0.0):
        train = train.unionByName(labelled.where(F.col("label") == label).orderBy("o", *FEATURES)
                                  .limit(training_findings).select(*FEATURES, "label"))
    # A bounded sample in one order, so that the forest draws the same rows every time.
    train = written(train.coalesce(1).sortWithinPartitions("label", *FEATURES), "training-findings").coalesce(1)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxMemoryInMB=128)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(train)
    probability = vector_to_array("probability")[1]
    return model.transform(all_found).select(
        "doc_id", "h", "k", "start", "end", "kind", F.sha2("value", 256).alias("value_sha256"),
        F.round(probability, 6).alias("probability"), (probability >= 0.5).alias("secret"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with each secret replaced by ``MASK``, and their length in ``chars_col`` if there is one.

    All rows and columns stay, whatever their names. Only texts with a candidate are shuffled.
    Null and empty texts stay as they are, null ids and repeated rows too; an empty table stays empty.
    """
    doc, h, ks, own, items, gaps = fresh(docs.columns, "found_id", "found_h", "found_k", "own_h", "items", "gaps")
    bad = (scan(docs, id_col, text_col).where("secret").groupBy(F.col("doc_id").alias(doc), F.col("h").alias(h))
           .agg(F.collect_set("k").alias(ks)))
    has = F.coalesce(F.col(text_col).rlike(CANDIDATE), F.lit(False))
    some = docs.where(has).withColumn(own, F.xxhash64(F.col(text_col)))
    some = some.join(bad, some[id_col].eqNullSafe(bad[doc]) & (some[own] == bad[h]), "left")
    some = some.withColumns({items: found_in(F.col(text_col)), gaps: F.split(text_col, CANDIDATE)})
    masked = F.transform(items, lambda item, k: F.concat(
        F.get(gaps, k), item["lead"], F.when(F.array_contains(ks, k), F.lit(MASK)).otherwise(item["value"])))
    text = F.concat(F.concat_ws("", masked), F.element_at(gaps, -1))
    some = some.withColumn(text_col, F.when(F.col(ks).isNull(), F.col(text_col)).otherwise(text))
    if chars_col in docs.columns:
        some = some.withColumn(chars_col, F.when(F.col(ks).isNull(), F.col(chars_col)).otherwise(
            F.length(text_col)).cast(docs.schema[chars_col].dataType))
    return docs.where(~has).unionByName(some.select(*docs.columns))
