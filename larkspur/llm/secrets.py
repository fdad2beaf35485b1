"""Secret scans: candidates by pattern, false positives removed by a random forest trained on labelled findings.

Everything here is DataFrame and SQL functions and JVM-side models.  A candidate is a word that holds a long run of
key characters with a digit, that starts a value with an issuer's prefix, that assigns a value to a name such as
``password``, or that follows such a name and its ``=``, ``:`` or "is" within two words.  The forest sees the candidate's
length, its changes between kinds of characters, how much of it is dictionary words, whether it is a path or address,
and its neighbouring words.  Values of fewer than 6 characters and values that hold spaces are not found as such, and a
value made of plain words only looks like prose to the forest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.llm.common import prepare, table

SPACE = r"[\x20\x09-\x0D]+"
#: Fewest key characters in a row, findings the default forest is trained on, its trees and depth, score that makes a secret
RUN, FINDINGS, TREES, DEPTH, LIMIT = 12, 12_000, 60, 9, 0.5
MASK = "<secret>"

# Names that secrets are assigned to, and issuers' prefixes
NAMES = "pass(?:word|wd|phrase)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|bearer|credential"
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abp]-|sk_live_|rk_live_|AIza|eyJ|npm_|SG\\."
# Words beside numbers and hashes that are no secrets
HARMLESS = "commit|sha|md5|checksum|digest|hash|uuid|guid|isbn|issn|doi|card|order|invoice|phone|tel|fax|version|build|id|ref|etag|revision"
PLACEHOLDER = r"example|changeme|placeholder|your|dummy|sample|redacted|x{4,}|\*{3,}|\.{3,}|\$\{|<[a-z]"
# Words that identifiers, paths and file names are made of
DICTIONARY = ["about", "access", "action", "admin", "agent", "alert", "android", "archive", "array", "asset", "async", "author", "background", "backup", "base", "batch", "before", "block",
              "border", "branch", "button", "cache", "callback", "center", "change", "channel", "check", "class", "clean", "client", "cloud", "code", "color", "column", "common", "component",
              "config", "connect", "content", "context", "control", "count", "create", "current", "custom", "data", "date", "debug", "default", "delete", "design", "device", "display", "docs",
              "document", "domain", "download", "driver", "dynamic", "editor", "element", "email", "enable", "error", "event", "example", "export", "factory", "feature", "field", "file",
              "filter", "folder", "format", "frame", "function", "global", "graph", "group", "handler", "header", "height", "help", "history", "home", "html", "http", "https", "icon", "image",
              "import", "index", "input", "install", "internal", "item", "java", "language", "layer", "layout", "left", "length", "level", "library", "license", "limit", "link", "list", "loader",
              "local", "logger", "login", "main", "manager", "market", "master", "media", "memory", "message", "method", "mobile", "model", "module", "monitor", "name", "network", "number",
              "object", "online", "option", "order", "output", "package", "page", "panel", "parameter", "parent", "parser", "path", "payment", "photo", "plugin", "policy", "position", "print",
              "process", "product", "profile", "project", "property", "public", "query", "queue", "record", "release", "remote", "report", "request", "resource", "response", "result", "right",
              "route", "sample", "schema", "screen", "script", "search", "section", "select", "server", "service", "session", "setting", "shared", "source", "static", "status", "storage",
              "stream", "string", "style", "submit", "support", "system", "table", "target", "template", "test", "text", "theme", "thread", "time", "title", "track", "transaction", "update",
              "upload", "user", "util", "value", "version", "video", "view", "widget", "width", "window", "worker", "wrapper"]

FEATURES = ["length", "digits", "upper", "lower", "marks", "kinds", "changes", "variety", "longest_letters", "dictionary", "spoken", "hex", "numeric", "path", "file", "prefix", "uuid",
            "placeholder", "named_here", "named_before", "assigned", "harmless_before", "harmless_after", "quoted", "dots"]


def split_value(word: Column) -> Column:
    """The value of an assignment, or the word itself, without the quotes and marks around it."""
    value = F.when(word.rlike(r"^[\"'(<\[{]*[A-Za-z][A-Za-z0-9_.-]{1,40}[\"']?[=:][^/]"), F.regexp_replace(word, r"^[^=:]*[=:]+", "")).otherwise(word)
    return bare(value)


def bare(word: Column) -> Column:
    """The word without the quotes and marks around it."""
    return F.regexp_replace(word, r"^[\"'`(<\[{=:]+|[\"'`)>\]},;.:!?]+$", "")


def named(word: Column, before: Column, before2: Column) -> Column:
    """Do the one or two words before ``word`` assign it to one of ``NAMES``?"""
    near = F.concat_ws(" ", before2, before)
    assigns = before.rlike(r"[=:]|^(?i:is)$") | before2.rlike("[=:]") | word.rlike("^[=:]")
    after_name = near.rlike(f"(?i)({NAMES})\\S*( \\S+)?( is| ?[=:>]+[\"'`]?)$") | near.rlike(f"(?i)({NAMES})\\S*[=:]+[\"'`]?( |$)") | (word.rlike("^[=:]") & before.rlike(f"(?i)({NAMES})"))
    return F.when(assigns, after_name).otherwise(False)


def share(value: Column, kind: str) -> Column:
    return F.regexp_count(value, F.lit(kind)) / F.greatest(F.length(value), F.lit(1))


def features(word: Column, value: Column, before: Column, before2: Column, after: Column) -> Column:
    """The forest's view of a finding, in the order of ``FEATURES``."""
    n = F.greatest(F.length(value), F.lit(1))
    low, near = F.lower(value), F.lower(F.concat_ws(" ", before2, before))
    runs = F.regexp_extract_all(low, F.lit("[a-z]{4,}"), F.lit(0))
    covered = lambda found: F.aggregate(found, F.lit(0), lambda a, w: a + F.length(w)) / n
    known = F.regexp_extract_all(low, F.lit("|".join(DICTIONARY)), F.lit(0))
    flag = lambda text, pattern: F.coalesce(text.rlike(pattern), F.lit(False))
    kinds = [value.rlike(p).cast("double") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]
    key = F.lower(F.regexp_extract(word, r"^([^=:]*)[=:]", 1))
    cols = [
        n, share(value, "[0-9]"), share(value, "[A-Z]"), share(value, "[a-z]"), share(value, "[^A-Za-z0-9]"), kinds[0] + kinds[1] + kinds[2] + kinds[3],
        share(value, "(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"), F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(40)),
        F.coalesce(F.array_max(F.transform(runs, lambda w: F.length(w))), F.lit(0)), covered(known), covered(F.filter(runs, lambda w: w.rlike("[aeiouy]"))),
        flag(value, "^[0-9a-fA-F]+$"), flag(value, r"^[0-9 .()+-]+$"), flag(value, "/.*/|://|^www\\.|\\\\"), flag(low, r"\.[a-z]{1,4}[0-9]?$"), flag(value, f"^({PREFIXES})"),
        flag(low, "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"), flag(low, PLACEHOLDER), flag(key, NAMES), flag(near, f"({NAMES})\\W*(key|value|string|code)?\\W*(is|=|:)?\\W*$"),
        flag(word, "[=:]") | flag(before, "[=:]$"), flag(near, f"\\b({HARMLESS})\\b"), flag(F.lower(after), f"^({HARMLESS})\\b"), flag(word, "[\"'`]"), share(value, r"\."),
    ]
    return F.array(*[c.cast("double") for c in cols])


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word_no, word, value, before, before2, after): every candidate of every whole text; word numbers start at 0."""
    digit, name = r"[0-9]", f"(?i)({NAMES})"
    long = "[A-Za-z0-9+/_=.-]{%d,}" % RUN
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.col("_text").rlike(f"{digit}|{PREFIXES}|{name}"))
    # a text that begins with white space has no word before its first
    rows = rows.select("_key", F.array_remove(F.split("_text", SPACE), "").alias("_words"))
    at = lambda i, n: F.coalesce(F.try_element_at("_words", (i + n + 1).cast("int")), F.lit(""))

    before = lambda i, n: F.when(i >= n, at(i, F.lit(-n))).otherwise("")

    def suspect(w: Column, i: Column) -> Column:
        assigned = w.rlike(f"(?i)({NAMES})[a-z_-]*[\"']?[=:][\"']?\\S{{6,}}")
        issued = w.rlike(f"(^|[^A-Za-z0-9])({PREFIXES})")
        return F.when(F.length(w) < 6, False).when(w.rlike(digit) & w.rlike(long), True).when(assigned | issued, True).otherwise(named(w, before(i, 1), before(i, 2)))

    found = F.filter(F.transform("_words", lambda w, i: F.when(suspect(w, i), i).otherwise(-1)), lambda i: i >= 0)
    rows = rows.select("_key", "_words", F.explode(found).alias("word_no"))
    i = F.col("word_no")
    word = at(i, F.lit(0))
    # a value may hold = or : itself: cut off only what is a name
    own_name = word.rlike(f"(?i)^[\"'(<\\[{{]*[a-z0-9_.-]*({NAMES})[a-z0-9_.-]*[\"']?[=:]")
    value = F.when(named(word, before(i, 1), before(i, 2)) & ~own_name, bare(word)).otherwise(split_value(word))
    return rows.select(F.col("_key").alias(key), "word_no", word.alias("word"), value.alias("value"), before(i, 1).alias("before"), before(i, 2).alias("before2"), at(i, F.lit(1)).alias("after")
                       ).filter(F.length("value") >= 6)


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(word, before, before2, after, secret): findings written by rule, where a user has no labelled ones of their own.

    Secrets follow the formats of well-known issuers and assignments; the others are what such scans trip over: hashes
    beside a commit or checksum, identifiers, card and phone numbers, paths, addresses, versions, long words.
    """
    h = F.concat(*[F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(k))) for k in ("a", "b", "c")])
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[\r\n=]", "")
    letters = F.translate(F.substring(h, 33, 24), "0123456789", "ghijklmnop")
    word = lambda k: F.element_at(F.array(*[F.lit(w) for w in DICTIONARY]), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    pick = lambda k, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(names))) + 1).cast("int"))
    digits = F.regexp_replace(F.concat(F.conv(F.substring(h, 1, 12), 16, 10), F.conv(F.substring(h, 13, 12), 16, 10)), "[^0-9]", "")
    size = (F.pmod(F.xxhash64("id", F.lit("size")), F.lit(24)) + 16).cast("int")
    cut = lambda c, n: F.substring(c, F.lit(1), n if isinstance(n, Column) else F.lit(n))
    key = pick("key", "password", "passwd", "PASSWORD", "secret", "token", "api_key", "API_KEY", "auth_token", "access_key", "client_secret", "db_password", "pwd")
    sep, quote, said = pick("sep", "=", ":", "=\"", "='"), pick("quote", "\"", "", "'"), word("said")
    upper32 = F.upper(F.translate(F.substring(h, 9, 16), "0189", "QXZW"))
    none, other = F.lit(""), word("near")
    mark, mark2 = pick("mark", "!", "#", "$", "@", "%", "&", "*", "-", "?", "^"), pick("mark2", "!", "#", "$", "@", "%", "&", "*", "_", "=", "~")
    small, few = (F.pmod(F.xxhash64("id", F.lit("small")), F.lit(7)) + 6).cast("int"), (F.pmod(F.xxhash64("id", F.lit("few")), F.lit(3)) + 1).cast("int")
    odd = lambda text: F.translate(text, "aeisot", "43!507")
    # values that people make up: a word with digits, a word in odd spelling, short letters and digits, marks between them
    made_up = F.element_at(F.array(
        F.concat(word("v"), cut(digits, few)), F.concat(word("v"), cut(digits, 1), cut(letters, 1)), F.concat(F.initcap(word("v")), cut(digits, few), mark), F.concat(F.initcap(odd(word("v"))), mark, cut(letters, few)),
        F.concat(odd(word("v")), mark, cut(b64, few)), cut(b64, small), cut(h, small), F.concat(cut(b64, 3), mark, F.substring(b64, 4, 3), mark2, F.substring(b64, 7, 3), mark, F.substring(b64, 10, 2)),
        F.concat(cut(b64, 3), mark, F.substring(b64, 4, 4), mark2), cut(digits, small)), (F.pmod(F.xxhash64("id", F.lit("made")), F.lit(10)) + 1).cast("int"))
    # what stands after such a name in prose and code
    spoken = F.element_at(F.array(
        word("v"), F.initcap(word("v")), F.concat(word("v"), pick("end", ",", ".", ";", "s", "ed")), F.concat(word("v"), F.lit("_"), word("w")), F.concat(word("v"), F.lit("."), word("w")), F.concat(word("v"), F.lit("-"), word("w")),
        F.concat(word("v"), F.initcap(word("w"))), F.concat(word("v"), F.lit("("), word("w"), F.lit(")")), F.concat(word("v"), F.lit("[\"DB_"), F.upper(word("w")), F.lit("\"]")), F.upper(word("v")),
        pick("p2", "changeme", "your_token_here", "${DB_PASSWORD}", "********", "xxxxxxxx", "<password>", "example", "[redacted]", "placeholder", "Bearer", "Basic", "required", "optional", "undefined", "process.env.TOKEN")),
        (F.pmod(F.xxhash64("id", F.lit("spoken")), F.lit(11)) + 1).cast("int"))
    colon, comma = pick("colon", ":", "="), pick("comma", "", ",", ";", "\",", "\"")
    yes = [
        (F.concat(key, sep, cut(h, size)), other, said, word("next")), (F.concat(key, sep, cut(b64, size)), other, said, word("next")),
        (F.concat(quote, cut(h, size), quote), pick("eq", "=", ":"), key, word("next")), (F.concat(quote, cut(b64, size), quote), pick("eq", "=", ":"), key, word("next")),
        (F.concat(cut(h, size)), F.concat(key, pick("eq", "=", ":")), other, word("next")), (F.concat(pick("issuer", "AKIA", "ASIA"), upper32), other, said, word("next")),
        (F.concat(pick("issuer", "AKIA", "ASIA"), upper32), pick("eq", "=", "key", "id"), key, word("next")), (F.concat(F.lit("ghp_"), cut(b64, 36)), other, said, word("next")),
        (F.concat(pick("issuer", "sk_live_", "xoxb-", "glpat-", "AIza", "npm_"), cut(b64, 32)), other, said, word("next")), (F.concat(F.lit("eyJ"), cut(b64, 40), F.lit("."), cut(F.reverse(b64), 24)), pick("b", "Bearer", "token"), said, none),
        (cut(b64, 40), key, said, word("next")), (F.concat(key, sep, cut(letters, 12), F.lit("#"), cut(h, 4)), other, said, word("next")),
        (made_up, F.concat(key, colon), other, word("next")), (F.concat(F.lit("\""), made_up, F.lit("\""), pick("comma", "", ",", "}")), F.concat(F.lit("\""), key, F.lit("\":")), other, word("next")),
        (F.concat(quote, made_up, quote), pick("eq", "=", ":", ":=", "is"), key, word("next")), (F.concat(key, sep, made_up, quote), other, said, word("next")),
        (F.concat(pick("issuer", "AKIA", "ASIA"), F.translate(upper32, "234567", "GHIJKL")), pick("eq", "=", "key", "id", "is"), other, word("next")),
        (F.concat(quote, pick("issuer", "AKIA", "ghp_", "sk_live_", "glpat-", "npm_"), F.translate(cut(b64, 36), "0123456789", "qrstuvwxyz"), quote), other, said, word("next")),
    ]
    no = [
        (cut(h, 40), pick("c", "commit", "sha", "revision", "sha1"), said, word("next")), (cut(h, 32), pick("m", "md5", "checksum", "etag", "digest:"), said, word("next")),
        (F.concat_ws("-", cut(h, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), pick("u", "uuid", "id", "request", "guid"), said, word("next")),
        (cut(digits, 16), other, said, word("next")), (cut(digits, 16), pick("n", "card", "order", "invoice", "phone"), said, word("next")),
        (F.concat(F.lit("+"), cut(digits, 12)), pick("n", "tel", "phone", "call"), said, none), (F.concat(word("x"), F.lit("_"), word("y"), F.lit("_"), cut(digits, 4)), other, said, word("next")),
        (F.concat(F.initcap(word("x")), F.initcap(word("y")), F.initcap(word("z")), cut(digits, 2)), other, said, word("next")),
        (F.concat(F.lit("https://www."), word("x"), F.lit(".com/"), word("y"), F.lit("/"), cut(h, 12)), other, said, word("next")),
        (F.concat(F.lit("/usr/"), word("x"), F.lit("/"), word("y"), F.lit("-"), cut(digits, 3), F.lit(".txt")), other, said, word("next")),
        (F.concat(F.lit("img/"), word("x"), F.lit("/"), cut(h, 16), F.lit(".png")), other, said, word("next")), (F.concat(word("x"), F.lit("-"), word("y"), F.lit("-2."), cut(digits, 2), F.lit(".1.jar")), other, said, none),
        (F.concat(key, sep, pick("p", "changeme123", "your_token_here_1", "${DB_PASSWORD_1}", "xxxxxxxxxxxx1", "********", "example-key-0001", "<your-key-1>")), other, said, word("next")),
        (F.concat(cut(letters, 14), cut(digits, 1)), other, said, word("next")), (F.concat_ws(".", cut(digits, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 3), F.substring(digits, 10, 3)), other, said, word("next")),
        (F.concat_ws("-", F.lit("2024"), cut(digits, 2), F.concat(F.substring(digits, 3, 2), F.lit("T10:20:30Z"))), other, said, word("next")), (F.concat(word("x"), F.lit("@"), word("y"), cut(digits, 3), F.lit(".com")), other, said, none),
        (F.concat(word("x"), F.lit("="), word("y"), F.lit("-"), cut(digits, 6)), other, said, word("next")), (F.concat(word("x"), F.lit(":"), cut(digits, 8), F.lit("/"), word("y")), other, said, none),
        (spoken, F.concat(key, colon), other, word("next")), (F.concat(F.lit("\""), spoken, comma), F.concat(F.lit("\""), key, F.lit("\":")), other, word("next")),
        (F.concat(quote, spoken, quote), pick("eq", "=", ":", ":=", "is"), key, word("next")), (F.concat(key, sep, spoken, quote), other, said, word("next")),
        (F.concat(F.initcap(word("v")), comma), pick("by", "author:", "authors:", "passenger:", "secretary:", "tokens:", "authority:"), other, word("next")),
        (F.concat(cut(digits, small)), pick("by", "tokens:", "authors:", "passengers:", "passes:"), other, word("next")),
        (F.concat(pick("issuer", "npm_", "SG.", "sk_live_", "ghp_"), word("v"), pick("joint", "_", "", "."), word("w")), other, said, word("next")),
    ]
    kinds = [F.struct(w.alias("word"), b.alias("before"), b2.alias("before2"), a.alias("after"), F.lit(s).alias("secret")) for group, s in ((yes, 1.0), (no, 0.0)) for w, b, b2, a in group]
    rows = spark.range(n).withColumn("f", F.element_at(F.array(*kinds), (F.pmod("id", F.lit(len(kinds))) + 1).cast("int")))
    return rows.select("f.*")


@dataclass
class SecretModel:
    forest: RandomForestClassificationModel

    def score(self, found: DataFrame) -> DataFrame:
        rows = found.withColumn("_features", array_to_vector(features(F.col("word"), F.col("value"), F.col("before"), F.col("before2"), F.col("after"))))
        return self.forest.transform(rows).withColumn("score", vector_to_array("_chance")[1]).drop("_features", "_raw", "_chance", "_class")


def learn_secrets(spark: SparkSession, labelled: DataFrame | None = None) -> SecretModel:
    """``labelled``: rows (word, before, before2, after, secret 0.0 / 1.0); by default those of :func:`labelled_findings`."""
    prepare(spark)
    rows = labelled_findings(spark) if labelled is None else labelled.filter("word is not null and secret is not null")
    rows = rows.withColumn("value", split_value(F.col("word")))
    fit = rows.select(features(F.col("word"), F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("before2", F.lit("")), F.coalesce("after", F.lit(""))).alias("dense"), F.col("secret").cast("double").alias("label"))
    fit = table(fit.coalesce(4), "findings").select(array_to_vector("dense").alias("_features"), "label")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", predictionCol="_class", rawPredictionCol="_raw", probabilityCol="_chance", numTrees=TREES, maxDepth=DEPTH, seed=7, maxMemoryInMB=64)
    return SecretModel(forest.fit(fit))


def scan(docs: DataFrame, model: SecretModel | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word_no, value, before, score, secret) of every candidate in every whole text.

    Null and empty texts hold none; repeated rows and null keys report their own; a text may hold a secret twice.
    Other columns are not read.  One narrow pass.
    """
    model = model or learn_secrets(docs.sparkSession)
    return model.score(candidates(docs, key, text)).select(key, "word_no", "value", "before", "score", (F.col("score") >= LIMIT).alias("secret"))


def scan_report(docs: DataFrame) -> DataFrame:
    """The findings with the values masked: the issuer's prefix if they begin with one, the length, and a hash to compare by."""
    return scan(docs).select("doc_id", "word_no", F.regexp_extract("value", f"^({PREFIXES})", 1).alias("starts"), F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "secret")


def redact(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """All rows of ``docs`` with every secret in ``text`` replaced by ``MASK``; ``n_chars``, if there, follows.

    A secret is masked inside the word where it was found, and where it stands alone as another word of that text;
    longer words that only contain its letters stay.  Rows are numbered, stored and matched to their own findings by that
    number: doc_id is not read, may be null or repeated.  Null and empty texts stay; all columns are kept, whatever their
    names; an empty table gives no row.
    """
    prepare(docs.sparkSession)
    rows = table(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "rows")
    hits = scan(rows.select("row", F.col("doc.text").alias("text")), model, key="row").filter("secret")
    hits = table(hits.groupBy("row").agg(F.collect_set(F.struct("word_no", "value")).alias("hits")), "found")
    rows = rows.join(hits, "row", "left")
    text, mask = F.col("doc.text"), F.lit(MASK)
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    # longer values first: one may hold another
    held = F.array_sort("hits", lambda a, b: F.length(b.value) - F.length(a.value))

    def clean(word: Column, i: Column) -> Column:
        word = F.aggregate(F.filter(held, lambda h: h.word_no == i), word, lambda w, h: F.replace(w, h.value, mask))
        own = bare(F.regexp_replace(word, r"^[\x20\x09-\x0D]+", ""))
        return F.when(F.exists("hits", lambda h: h.value == own), F.replace(word, own, mask)).otherwise(word)

    rest = F.regexp_extract(text, r"([\x20\x09-\x0D]*)\z", 1)
    masked = F.when(F.col("hits").isNull(), text).otherwise(F.concat(F.array_join(F.transform(words, clean), ""), rest))
    out = rows.select("hits", masked.alias("masked"), "doc")
    columns = {c: F.col("doc").getField(c) for c in docs.columns} | {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("hits").isNull(), F.col("doc.n_chars")).otherwise(F.length("masked").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[columns[c].alias(c) for c in docs.columns])
