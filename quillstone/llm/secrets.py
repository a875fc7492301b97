"""Secret scans: regular-expression candidates, and a random forest that removes false positives, all as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.exprs import let
from quillstone.llm.common import texts
from quillstone.llm.spans import running

KEYWORDS = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential"
RUN = "[A-Za-z0-9+/_-]"
#: The name may have a prefix, from the start of its run, so that no loose candidate takes the keyword.
ASSIGNED = rf"(?i:(?:(?<!{RUN}){RUN}*)?(?:{KEYWORDS})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?)([^\s\"'<>,;]{{8,}})"
# An equals sign ends a name; only as the padding of a key is it part of one.
PADDING = rf"={{1,2}}(?!{RUN}|=)"
LOOSE = rf"(?<!{RUN})(?:{RUN}{{16,}}+(?:{PADDING})?|{RUN}{{14,15}}{PADDING})"
BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
CANDIDATE = rf"{BLOCK}|{ASSIGNED}|{LOOSE}"
#: The same where a text has none of the keywords, which is found out several times faster.
UNNAMED = rf"{BLOCK}|{LOOSE}"
#: Code points read on either side of a candidate for its neighbouring words.
NEAR = 48
REPLACEMENT = "<SECRET>"

# Words that make up ordinary identifiers and placeholders.
DICTIONARY = (
    "access account admin application author backup base build cache change changeme chapter class client code color commit config connection "
    "content context control count create data database date debug default delete description dummy element email error event example export "
    "false field file filter format function group handler hello header hidden hostname image import index insert internal item label language "
    "length library license link list local localhost login manager message method model module name network number object option order "
    "output package page parameter password path person placeholder policy position private process product profile project property "
    "public query record release report request reset resource response result return sample schema secret section select server service "
    "session setting source start state status string style system table target template test text time title token true type update "
    "user value version view window with world xxxx your required undefined optional redacted"
).split()
# Words that people make passwords of, and words of prose that may follow a colon.
NAMES = (
    "hunter dragon monkey sunshine princess football baseball shadow michael jordan harley ranger buster thomas soccer tigger george summer winter purple "
    "orange banana cookie coffee pepper ginger silver golden flower chicken horse correct battery staple river mountain thunder lucky happy freedom "
    "matrix falcon phoenix tiger eagle rocket guitar violin london paris berlin madrid sydney diamond ruby daisy bella oliver sophie marina castle"
).split()
PROSE = (
    "remember different something everyone important following necessary available forgotten protected encrypted expected incorrect mandatory minimum "
    "anything together whenever yourself carefully regularly including otherwise prompted verified"
).split()
NEAR_SECRET = rf"(?i)(?:{KEYWORDS}|bearer|authorization)"
NEAR_HARMLESS = r"(?i)(?:sha-?\d*|md5|checksum|digest|commit|revision|uuid|guid|etag|example|placeholder|sample|isbn|version|integrity)"
HARMLESS_PATH = r"(?i)(?:test|spec|fixture|mock|example|sample|docs?)"
#: A candidate that its keyword is set to, and one that is code or a variable.
SET_TO = rf"(?i)(?:{KEYWORDS})[\"']?[ \t]{{0,3}}[:=]+>?[ \t]{{0,3}}[\"']?$"
CODE = r"[(){}\[\]$%]|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$"
FEATURES = "length transitions dictionary digits uppers distinct is_hex is_uuid is_path near_secret near_harmless in_tests assigned signs code".split()
TREES, DEPTH, SEED = 25, 6, 7


def _count(value: Column, pattern: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, pattern, ""))


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """FEATURES of one candidate, as doubles."""
    n = F.greatest(F.length(value), F.lit(1))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    columns = [
        F.length(value).cast("double"),
        (F.length(shape) - 1) / n,
        _count(F.lower(value), "(?:" + "|".join(DICTIONARY) + ")") / n,
        _count(value, "[0-9]") / n,
        _count(value, "[A-Z]") / n,
        F.size(F.array_distinct(F.split(value, ""))) / n,
        flag(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$")),
        flag(value.rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        flag(value.rlike(r"^[A-Za-z0-9._-]*/[A-Za-z0-9._/-]*[a-z]{3,}") & (_count(value, "[0-9]") / n < 0.2)),
        flag(before.rlike(NEAR_SECRET)),
        flag(before.rlike(NEAR_HARMLESS) | after.rlike(NEAR_HARMLESS)),
        flag(path.rlike(HARMLESS_PATH)),
        flag(before.rlike(SET_TO)),
        _count(value, "[^A-Za-z0-9_/+=-]") / n,
        flag(value.rlike(CODE)),
    ]
    return [c.cast("double").alias(f) for f, c in zip(FEATURES, columns)]


def labelled_findings(spark: SparkSession, rows: int = 8000) -> DataFrame:
    """value, before, after, path and label (1: a secret) of generated findings, for use where no reviewed ones are given.

    Secrets: random hexadecimal, alphanumeric and base64 keys beside words of credentials, and passwords as people make
    them: a word with digits and a sign, with letters written as digits, two words, a few letters and digits. Others:
    checksums, commit ids and UUIDs beside words for them, identifiers made of dictionary words, paths, long numbers, long
    words of prose; and beside words of credentials placeholders, variables, calls and single words of prose.
    """
    n = F.col("id")
    h = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), n.cast("string")), 256)
    pick = lambda salt, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(salt), n), F.lit(len(xs))) + 1).cast("int"))
    key = F.translate(F.base64(F.unhex(h("k"))), "+/=", "xyz")
    word = lambda salt: pick(salt, DICTIONARY)
    prose = F.translate(h("o"), "0123456789abcdef", "etaoinshrdlucmfp").substr(F.lit(1), (F.pmod(F.xxhash64(F.lit("l"), n), F.lit(25)) + 16).cast("int"))
    cased = F.pmod(F.xxhash64(F.lit("z"), n), F.lit(3))
    filler = F.concat_ws(" ", word("f1"), word("f2"), word("f3"))
    name = lambda salt: F.when(F.pmod(F.xxhash64(F.lit(salt), F.lit("c"), n), F.lit(3)) == 0, F.initcap(pick(salt, NAMES))).otherwise(pick(salt, NAMES))
    number = lambda salt, most: F.pmod(F.xxhash64(F.lit(salt), n), F.lit(most)).cast("string")
    mark = lambda salt: pick(salt, ["!", "@", "#", "?", ".", "$", "_", "-", "*"])
    short = F.translate(h("q"), "012345", "ghjkmw").substr(F.lit(1), (F.pmod(F.xxhash64(F.lit("r"), n), F.lit(7)) + 8).cast("int"))
    named_in_code = F.concat_ws("_", word("j1"), word("j2"))
    secret_word = pick("s", ["token", "api_key", "secret", "password", "access_key", "client_secret", "Authorization: Bearer", "private-key"])
    asked = pick("s2", ["password", "passwd", "pwd", "DB_PASSWORD", "secret", "api_key", "user_password", "token"])
    given = pick("a2", [" = ", "=", ": ", " = '", '="', "='", ': "', ":"])
    sign = pick("a", [' = "', ": ", "=", ' := "', " => '"])
    hash_word = pick("c", ["sha256", "sha1", "md5", "checksum", "commit", "revision", "digest", "etag", "integrity"])
    uuid = F.concat_ws("-", *(F.substring(h("u"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    cut_at = (F.pmod(F.xxhash64(F.lit("n"), n), F.lit(25)) + 16).cast("int")
    kinds = [
        (h("x").substr(F.lit(1), pick("w", [32, 40, 64])), F.concat(filler, F.lit(" "), secret_word, sign), 1),
        (key.substr(F.lit(1), cut_at), F.concat(filler, F.lit(" "), secret_word, sign), 1),
        (F.concat(pick("p", ["AKIA", "ghp_", "sk_live_", "xoxb-"]), key.substr(F.lit(1), F.lit(32))), F.concat(filler, F.lit(" ")), 1),
        (F.concat(pick("p", ["AKIA", "ghp_", "sk_live_", "glpat-"]), key.substr(F.lit(1), F.lit(24))), F.concat(secret_word, sign), 1),
        (F.rpad(F.concat(name("n1"), number("d1", 10000), mark("m1")), 8, "7"), F.concat(filler, F.lit(" "), asked, given), 1),
        (F.rpad(F.concat(F.translate(name("n2"), "aeiost", "431057"), name("n3"), number("d2", 100)), 8, "7"), F.concat(filler, F.lit(" "), asked, given), 1),
        (F.rpad(F.concat(name("n4"), pick("j", ["", "", "-", ".", "_"]), name("n5"), pick("j2", ["", "", "1", "99"])), 12, "s"), F.concat(filler, F.lit(" "), asked, given), 1),
        (short, F.concat(filler, F.lit(" "), asked, given), 1),
        (F.concat(pick("k1", ["settings.", "config.", "self.", "os.environ.", "$", "${", "get_", "%("]), F.when(F.pmod(n, F.lit(2)) == 0, F.upper(named_in_code)).otherwise(named_in_code), pick("k2", ["", "", "(", "}", "()"])), F.concat(filler, F.lit(" "), asked, given), 0),
        (F.concat(pick("k3", ["settings.", "config.", "self.", "getpass(", "env[", "{{"]), named_in_code), F.concat(filler, F.lit(" "), asked, given), 0),
        (pick("pr", PROSE), F.concat(filler, F.lit(" "), asked, F.lit(": ")), 0),
        (F.concat(word("c1"), F.initcap(word("c2")), F.initcap(word("c3"))), F.concat(filler, F.lit(" "), asked, given), 0),
        (h("y").substr(F.lit(1), pick("w", [32, 40, 64])), F.concat(filler, F.lit(" "), hash_word, F.lit(" ")), 0),
        (uuid, F.concat(filler, pick("v", [" uuid ", " guid ", " id ", " request "])), 0),
        (F.concat_ws("_", word("i1"), word("i2"), word("i3")), F.concat(filler, pick("v2", [" ", " call ", " token = ", " secret: "])), 0),
        (F.concat_ws("/", word("i1"), word("i2"), F.concat(word("i3"), F.lit("page"))), F.concat(filler, F.lit(" ")), 0),
        (F.translate(h("d"), "abcdef", "314159").substr(F.lit(1), cut_at), F.concat(filler, F.lit(" number ")), 0),
        (F.concat(pick("e", ["your-", "example-", "changeme-", "xxxxxxxx"]), word("i1"), F.lit("-"), word("i2")), F.concat(secret_word, sign), 0),
        (F.when(cased == 0, prose).when(cased == 1, F.initcap(prose)).otherwise(F.upper(prose)), F.concat(filler, F.lit(" ")), 0),
    ]
    which = F.pmod(n, F.lit(len(kinds)))
    chain = lambda k: reduce(lambda c, x: c.when(which == x[0], x[1][k] if k < 2 else F.lit(x[1][k])), enumerate(kinds[1:], 1), F.when(which == 0, kinds[0][k] if k < 2 else F.lit(kinds[0][k])))
    return spark.range(0, rows, 1, 2).select(
        chain(0).alias("value"),
        chain(1).alias("before"),
        F.concat(F.lit(" "), word("z")).alias("after"),
        pick("path", ["src", "web", "lib/main", "tests/unit", "docs/guide"]).alias("path"),
        chain(2).cast("double").alias("label"),
    )


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest over FEATURES of labelled findings: value, before, after, path, label. Rows with a null value or label don't count."""
    known = findings.where(F.col("value").isNotNull() & F.col("label").isNotNull()).select(
        *features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.coalesce("path", F.lit(""))), "label"
    )
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(known)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return forest.fit(rows)


def forest_column(model: RandomForestClassificationModel, x: list[Column]) -> Column:
    """The share of trees that vote for a secret, as nested conditional expressions over the features."""

    def grown(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(x[split.featureIndex()] <= F.lit(float(split.threshold())), grown(node.leftChild())).otherwise(grown(node.rightChild()))

    trees = [grown(t._call_java("rootNode")) for t in model.trees]
    return reduce(lambda a, b: a + b, trees) / F.lit(float(len(trees)))


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, least: float = 0.5, path: str = "source") -> DataFrame:
    """docs with _pieces, _matches and _found: the text between candidates, the candidates' matches, and for each candidate
    start, end (code points), value, score and secret (score >= ``least``). No row moves and nothing is shuffled.

    Null and empty texts have one empty piece and no candidates; repeated rows are scanned alike.
    """
    spark = docs.sparkSession
    model = model or train(labelled_findings(spark))
    place = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    text = F.coalesce(F.col("text"), F.lit(""))
    named = text.rlike(f"(?i)(?:{KEYWORDS})")
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    staged = docs.select("*", F.when(named, every(CANDIDATE)).otherwise(every(UNNAMED)).alias("_matches")).withColumn(
        "_pieces", F.when(F.size("_matches") == 0, F.array(text)).when(named, F.split(text, CANDIDATE, -1)).otherwise(F.split(text, UNNAMED, -1))
    )

    def found(m: Column, p: Column) -> Column:
        sizes = lambda xs: running(F.transform(xs, lambda s: F.length(s)))

        def one(x: Column, i: Column, before: Column, own: Column) -> Column:
            inner = F.regexp_extract(x, "^" + ASSIGNED + "$", 1)
            value = F.when(inner != "", inner).otherwise(x)
            end = before[i + 1] + own[i] + F.length(x)
            # A long name before an equals sign is a candidate too; it still is what stands before the value.
            name = F.when((i > 0) & (p[i] == "="), m[F.greatest(i - 1, F.lit(0))]).otherwise("")
            lead = F.concat(name, F.substring(p[i], F.greatest(F.length(p[i]) - NEAR + 1, F.lit(1)), F.lit(NEAR)), F.substring(x, F.lit(1), F.length(x) - F.length(value)))
            return let(
                F.struct(value.alias("value"), lead.alias("before"), F.substring(p[i + 1], 1, NEAR).alias("after")),
                lambda c: let(
                    F.struct(*features(c["value"], c["before"], c["after"], place)),
                    lambda f: F.struct(
                        (end - F.length(c["value"])).alias("start"),
                        end.alias("end"),
                        c["value"].alias("value"),
                        F.when(x.startswith("-----BEGIN"), F.lit(1.0))
                        .otherwise(forest_column(model, [f[n] for n in FEATURES]))
                        .alias("score"),
                    ),
                ),
            )

        return let(sizes(p), lambda before: let(sizes(m), lambda own: F.transform(m, lambda x, i: one(x, i, before, own))))

    none = F.array().cast("array<struct<start:int,end:int,value:string,score:double>>")
    scored = F.when(F.size("_matches") > 0, let(F.col("_matches"), lambda m: let(F.col("_pieces"), lambda p: found(m, p)))).otherwise(none)
    return staged.withColumn("_scored", scored).select(
        *docs.columns,
        "_pieces",
        "_matches",
        F.transform("_scored", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), c["score"].alias("score"), (c["score"] >= least).alias("secret"))).alias("_found"),
    )


def findings(docs: DataFrame, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """One row a document: doc_id, n_candidates, n_secrets, secrets (start:end, comma-joined) and redacted (the text)."""
    scanned = scan(texts(docs, *(["source"] if "source" in docs.columns else [])), model)
    kept = F.filter("_found", lambda c: c["secret"])
    return scanned.select(
        "doc_id",
        F.size("_found").cast("long").alias("n_candidates"),
        F.size(kept).cast("long").alias("n_secrets"),
        F.array_join(F.transform(kept, lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"))), ",").alias("secrets"),
        _redacted().alias("redacted"),
    )


def _redacted() -> Column:
    def rebuilt(p: Column, m: Column, c: Column) -> Column:
        clean = lambda x, i: F.when(c[i]["secret"], F.concat(F.substring(x, F.lit(1), F.length(x) - F.length(c[i]["value"])), F.lit(REPLACEMENT))).otherwise(x)
        cleaned = let(F.transform(m, clean), lambda y: F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(F.concat(y[F.greatest(i - 1, F.lit(0))], x))))
        return F.array_join(cleaned, "")

    several = let(F.col("_pieces"), lambda p: let(F.col("_matches"), lambda m: let(F.col("_found"), lambda c: rebuilt(p, m, c))))
    return F.when(F.size("_matches") > 0, several).otherwise(F.col("_pieces")[0])


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """docs with REPLACEMENT for every secret, n_chars to match, and all other columns as they were. Null texts stay null."""
    held = docs.select("text", *(["source"] if "source" in docs.columns else []), F.struct("*").alias("_row"))
    clean = scan(held, model).select("_row", F.when(F.col("text").isNotNull(), _redacted()).alias("_text"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_text").isNotNull(), F.length("_text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
