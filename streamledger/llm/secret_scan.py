"""Secret scans, with DataFrame operations only: candidates, then a random forest that removes false findings.

Every run of a secret's characters, within a word of a text, that is long enough and in a
word with a digit, or follows a telling key, or has a known form, is a candidate. The forest (Spark ML) judges it by its length, the transitions between
kinds of characters in it, how much of it dictionary words cover, the path it came
from and the words beside it. It is trained on labelled findings; ``labelled_findings``
makes a set of them by rules, for use where nobody has labelled any.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamledger.llm.common import pinned, text_or_empty

LEAST_LENGTH = 12
THRESHOLD = 0.5
TREES, DEPTH, SEED = 24, 8, 7
#: Labelled findings that ``labelled_findings`` makes.
EXAMPLES = 6_000

#: Words of everyday text and of identifiers; what they cover is no random string.
DICTIONARY = (
    "about above access account action active address admin after alpha angle array author backup base batch beta blog body branch buffer build button cache call change char check child class client clone cloud code column comment commit common config connect content context control copy core count create current custom data database date debug default delete demo detail device document domain download driver dummy element email engine entry error event example export factory feature field file filter final first folder format frame function general global group handle header height hello host html http https image import index info input insert instance internal issue item java join json kernel label last layer layout length level library license limit line link list load local location login lower main manager master match media member message method model module month name network node normal note notes number object office order other output owner package page param parent part partner path photo picture place placeholder plain player point policy post print private process product profile project property public python query random read record region release report request reset resource response result review right root router sample schema scope screen script search second section select server service session setting shop simple site size socket source stack start state static status step store stream string style subject submit support switch system table target task team template test text theme thread time title topic track train type unit update upload user value version video view visit weather week welcome width window work world write year"
).split()

#: Words beside or before a value that speak for a secret, and against one.
TELLING = "passw(or)?d|passwd|pwd|secret|token|api_?-?key|access_?-?key|auth|bearer|credential|private"
HARMLESS = "commit|sha(1|256)?|md5|checksum|digest|hash|revision|uuid|guid|build|version|isbn|order|invoice|phone|card|account|example|placeholder|dummy"

#: A run of a secret's characters; "=" behind it is padding, unless a value follows.
CHARS = r"A-Za-z0-9_+/.~\-"
RUN = rf"[{CHARS}]+(?:={{1,2}}(?![{CHARS}=]|[\"'][{CHARS}]))?"

#: What stands before a value that has a telling key: an assignment, a flag of a command, or a bearer.
KEYED = rf"(?:({TELLING})([_-]?key)?[\"'\])]*\s*[:=]+>?\s*|(?:^|\s)--?[a-z0-9-]*({TELLING})\s+|\bbearer\s+)[\"'`]*$"
#: Words that may hold a value of a known form.
KNOWN = r"(AKIA|ASIA)[0-9A-Z]{16}|(gh[pousr]_|xox[abp]-|sk_live_|AIza|glpat-)[0-9A-Za-z_\-]{10}|:[^/@\s]+@"

FEATURES = ["length", "transitions", "runs", "digits", "upper", "vowels", "distinct", "hex", "covered", "repeats", "shape", "key", "beside", "harmless", "trial_path", "quoted"]


def _share(count: Column) -> Column:
    return count / F.greatest(F.lit(1), F.length("value"))


def _pieces(word: str) -> Column:
    """The runs of a word and the gaps around them, one more than there are runs."""
    return F.struct(F.regexp_extract_all(word, F.lit(RUN), F.lit(0)).alias("runs"), F.split(word, RUN, -1).alias("gaps"))


def _values(pieces: Column) -> Column:
    """``value, lead, tail`` of each run: the run without full stops at its end, and what stands next to it in the word.

    ``lead`` reaches back over two more runs, ``tail`` forth over one, so a long word is not copied for each run.
    """
    runs, gaps = pieces["runs"], pieces["gaps"]
    part = lambda of, i: F.coalesce(F.get(of, i), F.lit(""))

    def value(run: Column, i: Column) -> Column:
        short = F.call_function("rtrim", F.lit("."), run)
        lead = F.concat(*[part(of, i - k) for of, k in ((gaps, 2), (runs, 2), (gaps, 1), (runs, 1), (gaps, 0))])
        tail = F.concat(F.substr(run, F.length(short) + 1), part(gaps, i + 1), part(runs, i + 1))
        return F.struct(short.alias("value"), lead.alias("lead"), tail.alias("tail"))

    return F.transform(runs, value)


def _shape(value: Column, lead: Column, tail: Column) -> Column:
    """A number for values of a known form: above 0 for secrets, below for what is none."""
    return (
        F.when(value.rlike(r"^(AKIA|ASIA)[0-9A-Z]{16}$"), 1.0)
        .when(value.rlike(r"^(gh[pousr]_|xox[abp]-|sk_live_|AIza|glpat-)[0-9A-Za-z_\-]{10,}$"), 2.0)
        # user:value@host
        .when(F.startswith(tail, F.lit("@")) & lead.rlike(r"(^|[^A-Za-z0-9_.~@\-])[A-Za-z0-9_.~\-]+:$"), 3.0)
        .when(tail.rlike(r"^@[A-Za-z0-9.\-]+\.[a-z]{2,}") | (F.endswith(lead, F.lit("@")) & value.rlike(r"\.[a-z]{2,}$")), -1.0)
        .when(F.startswith(value, F.lit("//")) & lead.rlike("[a-z]:$"), -2.0)
        .when(value.rlike(r"^[0-9.\-/]+$"), -3.0)
        .when(F.lower(value).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), -4.0)
        .otherwise(0.0)
    )


def _head(before2: str, before: str, lead: str | Column) -> Column:
    """What stands before a value, over two words and its own, in lower case."""
    return F.lower(F.concat_ws(" ", before2, before, lead))


def features(findings: DataFrame) -> DataFrame:
    """``findings(word, before, before2, after, path)`` with ``value`` and the columns of ``FEATURES``.

    A column ``value`` tells which run of the word is meant; without it, or where it is
    null, the last one is. Null strings count as empty.
    """
    given = findings
    if "lead" not in findings.columns:
        values = _values(_pieces("word"))
        if "value" in findings.columns:
            values = F.filter(values, lambda v: F.col("value").isNull() | (v["value"] == F.col("value")))
        given = given.withColumn("word", text_or_empty("word")).withColumn("meant", F.try_element_at(values, F.lit(-1)))
        given = given.withColumns({c: F.col("meant")[c] for c in ("value", "lead", "tail")}).drop("meant")
    given = given.withColumns({c: text_or_empty(c) for c in ("value", "lead", "tail", "before", "before2", "after", "path")})
    # what stands before the value in the word, or before the word, is its key
    given = given.withColumn("head", _head("before2", "before", "lead"))
    value, low = F.col("value"), F.lower("value")
    runs = F.regexp_count(value, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"))
    plain = F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    return given.withColumns(
        {
            "length": F.length("value").cast("double"),
            "transitions": (runs - 1) / F.greatest(F.lit(1), F.length("value") - 1),
            "runs": runs.cast("double"),
            "digits": _share(F.regexp_count(value, F.lit("[0-9]"))),
            "upper": _share(F.regexp_count(value, F.lit("[A-Z]"))),
            "vowels": _share(F.regexp_count(low, F.lit("[aeiou]"))),
            "distinct": _share(F.size(F.array_distinct(F.split(value, "")))),
            "hex": low.rlike("^[0-9a-f]+$").cast("double"),
            "covered": _share(F.length("value") - F.length(plain)),
            "repeats": _share(F.regexp_count(low, F.lit(r"(.)\1\1"))),
            "shape": _shape(value, F.col("lead"), F.col("tail")),
            "key": F.col("head").rlike(KEYED).cast("double"),
            "beside": F.concat_ws(" ", "head", F.lower("after")).rlike(TELLING).cast("double"),
            "harmless": F.concat_ws(" ", "head", F.lower("after")).rlike(f"\\b({HARMLESS})\\b").cast("double"),
            "trial_path": F.lower("path").rlike("test|example|sample|mock|fixture|demo|docs?/").cast("double"),
            "quoted": (F.col("lead").rlike("[\"'`]$") | F.col("tail").rlike("^[\"'`]")).cast("double"),
        }
    )


def labelled_findings(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """``n`` findings with ``label`` 1.0 for secrets, by rules over a hash of their number: no two runs differ."""
    i = F.col("id")
    part = lambda k: F.sha2(F.concat_ws(":", F.lit(str(k)), i.cast("string")), 256)
    pick = lambda k, *of: F.element_at(F.array(*[F.lit(x) for x in of]), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(of))) + 1).cast("int"))
    number = lambda k, most: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(most))
    mixed = F.regexp_replace(F.base64(F.unhex(part(1))), "[+/=\\s]", "")
    upper = F.translate(F.upper(F.substring(part(2), 1, 16)), "0123456789", "QRSTUVWX23")
    digits = F.translate(F.substring(part(3), 1, 16), "abcdef", "024689")
    words = F.concat(pick(4, *DICTIONARY), pick(5, "_", "-", "", "."), pick(6, *DICTIONARY), number(7, 1000).cast("string"))
    dotted = F.concat_ws(".", *[number(20 + k, 256).cast("string") for k in range(4)])
    uuid = F.concat_ws("-", *[F.substring(part(8), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    key = pick(9, "password", "passwd", "secret", "token", "api_key", "access_key", "auth_token", "client_secret")
    glue = pick(10, "=", ": ", " = ", ":", "='", ' = "', '="')
    end = F.when(F.substr(glue, F.length(glue)).isin("'", '"'), F.substr(glue, F.length(glue))).otherwise("")
    random = F.element_at(F.array(F.substring(part(11), 1, 18), F.substring(part(11), 1, 32), F.substring(part(11), 1, 40), part(11), F.substring(mixed, 1, 20), F.substring(mixed, 1, 40)), (number(12, 6) + 1).cast("int"))
    given = F.concat(key, glue, random, end)
    fake = F.concat(key, glue, pick(13, "your_api_key_here1", "changeme12345", "xxxxxxxxxxxx1", "example_password_1", "00000000000000000000", "1234567890123456", "REPLACE_ME_123", "test_user_token_1"), end)
    other = F.concat(pick(14, "commit", "sha1", "md5", "checksum", "revision", "digest"), pick(15, " ", ": ", " = "), F.substring(part(16), 1, 40))
    kinds = [
        (given, 1.0), (given, 1.0), (F.concat(F.lit("AKIA"), upper), 1.0), (F.concat(pick(17, "ghp_", "xoxb-", "sk_live_", "glpat-"), F.substring(mixed, 1, 36)), 1.0),
        (fake, 0.0), (other, 0.0), (uuid, 0.0), (digits, 0.0), (dotted, 0.0), (words, 0.0),
        (F.concat(words, F.lit("@mail"), number(18, 9).cast("string"), F.lit(".example.com")), 0.0),
        (F.concat(F.lit("https://"), pick(4, *DICTIONARY), F.lit(".example.org/"), words), 0.0),
        (F.concat_ws("-", (number(19, 60) + 1970).cast("string"), F.lpad((number(30, 12) + 1).cast("string"), 2, "0"), F.lpad((number(31, 28) + 1).cast("string"), 2, "0")), 0.0),
    ]
    # the value is not the last run of these words
    site = F.concat(pick(4, *DICTIONARY), F.lit(".example.org/"))
    hash_ = F.substring(part(16), 1, 40)
    inside = [
        (F.concat(F.lit('{"'), key, F.lit('":"'), random, F.lit('","id":'), number(7, 1000).cast("string"), F.lit("}")), 1.0, random),
        (F.concat(F.lit("https://"), site, F.lit("?"), key, F.lit("="), random, F.lit("&x="), number(7, 1000).cast("string")), 1.0, random),
        (F.concat(pick(50, "postgres://", "https://", "redis://", ""), pick(5, *DICTIONARY), F.lit(":"), random, F.lit("@"), site, pick(6, *DICTIONARY)), 1.0, random),
        (F.concat(F.lit('{"'), pick(14, "commit", "sha1", "md5", "checksum", "revision", "digest"), F.lit('":"'), hash_, F.lit('","id":'), number(7, 1000).cast("string"), F.lit("}")), 0.0, hash_),
        (F.concat(F.lit("https://"), site, F.lit("?"), pick(51, "id", "order", "page", "ref"), F.lit("="), digits, F.lit("&x="), number(7, 1000).cast("string")), 0.0, digits),
    ]
    # letters alone, short values, and what follows a key without being a secret
    letters = lambda k, n: F.translate(F.substring(part(k), 1, n), "0123456789abcdef", "ghijklmnopqrstuv")
    odd = lambda k: F.translate(F.substring(part(k), 1, 5), "0123456789abcdef", "aeioulnrstmcbdhp")
    phrase = F.concat_ws("-", odd(60), pick(61, *DICTIONARY), odd(62))
    case = F.element_at(F.array(letters(63, 20), F.upper(letters(63, 32)), F.regexp_replace(mixed, "[0-9]", "")), (number(64, 3) + 1).cast("int"))
    short = F.element_at(F.array(F.concat(odd(65), number(66, 100).cast("string")), F.substring(mixed, 1, 8), F.substring(mixed, 1, 10), F.concat(pick(67, *DICTIONARY), (number(68, 900) + 100).cast("string"))), (number(69, 4) + 1).cast("int"))
    phrases = F.element_at(F.array(phrase, F.concat_ws("-", odd(60), odd(70), odd(62)), F.concat_ws("_", odd(60), odd(62))), (number(71, 3) + 1).cast("int"))
    flag = F.concat(pick(72, "Bearer ", "bearer ", "--password ", "--token ", "--api-key "), F.when(number(73, 2) == 0, random).otherwise(case))
    bare = F.concat(F.lit("AKIA"), F.translate(upper, "23", "YZ"))
    nothing = pick(74, "None", "null", "true", "false", "string", "String", "str", "required", "optional", "password", "token", "secret", "value", "xxxx", "changeme", "your_password", "your-token-here", "<password>", "self.password", "request.token", "user.secret", "get_token()", "os.environ", "config.secret", "the", "a", "is", "must", "not")
    said = F.when(number(75, 2) == 0, pick(76, *DICTIONARY)).otherwise(nothing)
    inside += [
        (F.concat(key, glue, phrases, end), 1.0, None), (F.concat(key, glue, case, end), 1.0, None), (F.concat(key, glue, short, end), 1.0, None),
        (flag, 1.0, None), (bare, 1.0, None), (F.concat(key, glue, said, end), 0.0, F.regexp_extract(said, "[A-Za-z_.-]+", 0)), (F.concat(key, glue, said, end), 0.0, F.regexp_extract(said, "[A-Za-z_.-]+", 0)),
    ]
    inside = [(made, is_secret, F.lit(None).cast("string") if meant is None else meant) for made, is_secret, meant in inside]
    kinds = [*[(made, is_secret, F.lit(None).cast("string")) for made, is_secret in kinds], *inside]
    kind = number(40, len(kinds))
    text, label, value = (F.when(kind == 0, x) for x in kinds[0])
    for k, (made, is_secret, meant) in enumerate(kinds[1:], 1):
        text, label, value = text.when(kind == k, made), label.when(kind == k, is_secret), value.when(kind == k, meant)
    words_ = F.split(F.concat_ws(" ", pick(41, *DICTIONARY), pick(42, *DICTIONARY), text, pick(43, *DICTIONARY)), " ")
    rows = spark.range(n).select(words_.alias("w"), label.alias("label"), value.alias("value"), pick(44, "src/main", "lib/core", "app", "src0", "tests/unit", "docs/example", "config").alias("path"))
    at = F.size("w") - 1
    return rows.select(
        F.element_at("w", at).alias("word"), F.element_at("w", at - 1).alias("before"), F.element_at("w", at - 2).alias("before2"), F.element_at("w", at + 1).alias("after"), "path", "label", "value"
    )


def train(findings: DataFrame) -> RandomForestClassificationModel | float:
    """A random forest on ``findings(word, before, before2, after, path, label)``, and ``value`` where they have it.

    Rows without a label teach nothing; rows that repeat count each. Where one class is
    missing no forest can be grown: the result is a constant probability, 1.0 if all
    findings are secrets, 0.0 if none is or there are no findings.
    """
    findings = findings.where("label is not null")
    known = {r["label"] > 0 for r in findings.select((F.col("label") > 0).cast("int").alias("label")).distinct().collect()}
    if len(known) < 2:
        return float(True in known)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(findings)).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(rows)


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, at, value, lead, tail, before, before2, after, path``: the runs of words that may be a secret, ``at`` the word's number from 0.

    Null and empty texts have none; a value that repeats is a candidate at each place, and
    rows that repeat give theirs each. Texts are read whole, however long. Other columns are ignored.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(path).alias("path") if path else F.lit("").alias("path"), text_or_empty("text").alias("text"))
    # a text without any of the keys needs no look at what follows them
    telling = F.lower("text").rlike(TELLING)
    words = pinned(pinned(given, "telling", telling), "w", F.split("text", r"[\x20\x09-\x0D]+", -1)).select("doc_id", "path", "telling", "w")
    at = F.sequence(F.lit(0), F.size("w") - 1)
    word = lambda i: F.get("w", i)
    tells = F.when(F.col("telling"), F.filter(at, lambda i: F.lower(word(i)).rlike(TELLING))).otherwise(F.array().cast("array<int>"))
    # the value of a key is in its own word or in the next two
    words = pinned(words, "follow", F.array_distinct(F.flatten(F.transform(tells, lambda i: F.array(i, i + 1, i + 2)))))
    known = F.filter(at, lambda i: ((F.length(word(i)) >= LEAST_LENGTH) & word(i).rlike("[0-9]")) | word(i).rlike(KNOWN))
    found = F.array_union(known, F.filter("follow", lambda i: i < F.size("w")))
    picked = pinned(words, "found", found).where(F.size("found") > 0)
    # only the words around each candidate leave the row
    around = F.transform("found", lambda i: F.struct(i.alias("at"), *[F.get("w", i + k).alias(name) for k, name in ((0, "word"), (-1, "before"), (-2, "before2"), (1, "after"))]))
    rows = picked.select("doc_id", "path", F.explode(around).alias("c")).select("doc_id", "path", "c.*")
    # only the runs themselves leave the word, which may be a whole minified file
    rows = pinned(pinned(rows, "pieces", _pieces("word")), "digit", F.col("word").rlike("[0-9]"))

    def wanted(v: Column) -> Column:
        long = F.col("digit") & (F.length(v["value"]) >= LEAST_LENGTH)
        return long | ((v["value"] != "") & (_head("before2", "before", v["lead"]).rlike(KEYED) | (_shape(v["value"], v["lead"], v["tail"]) > 0)))

    values = F.filter(_values(F.col("pieces")), wanted)
    rows = rows.select("doc_id", "path", "at", "before", "before2", "after", F.explode(values).alias("v"))
    return rows.select("doc_id", "path", "at", "before", "before2", "after", "v.*")


def scan(docs: DataFrame, model: RandomForestClassificationModel | float, path: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Findings that the forest keeps: ``doc_id, at, value_sha256, shown, probability``.

    ``at`` is the number of the word in the text, and a word may have several; ``shown`` has the value's first four
    characters, so that a report does not leak it. Null and empty texts have no findings;
    rows that repeat are scanned one by one; a null path counts as empty.
    """
    if isinstance(model, float):
        judged = candidates(docs, path).withColumn("probability", F.lit(model))
    else:
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(candidates(docs, path)))
        judged = model.transform(rows).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return judged.where(F.col("probability") >= threshold).select(
        "doc_id", F.col("at").cast("long").alias("at"), F.sha2(F.encode("value", "UTF-8"), 256).alias("value_sha256"), F.concat(F.substring("value", 1, 4), F.lit("...")).alias("shown"), "probability"
    )
