"""Secret scans: a random forest over candidates removes false positives.

Candidates are wide: values after an assignment or within quotes, passwords in addresses, private keys, vendors' key
formats, and long runs of letters and digits anywhere. The forest decides by length, transitions between character
classes, coverage by dictionary words, the path, and the words next to them; it is trained on labelled
findings, whose negatives have the shapes of secrets. All of it is DataFrame operations; nothing runs in Python on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotonflow.llm.common import materialize

#: Formats that vendors give their keys.
VENDOR = r"(?:A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|[sr]k_(?:live|test)_[A-Za-z0-9]{12,}+|AIza[A-Za-z0-9_-]{30,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*+)"
#: No alternative backtracks over more than a bounded number of characters.
CANDIDATE = "|".join(
    [
        r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:[^-]|-(?!----))++-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----",
        r"(?<=:)(?<=://[^\s/:@]{1,64}:)[^\s/@:]{3,}+(?=@)",
        rf"(?<![A-Za-z0-9]){VENDOR}",
        r"(?<=[=:][\"' ]{0,2})(?!(?:[A-Za-z][A-Za-z0-9+.-]{1,12}:)?//)[^\s\"'<>;,=:][^\s\"'<>;,]{5,}+",
        r"(?<=[\"'])[^\s\"'<>]{8,}+(?=[\"'])",
        r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*+[A-Za-z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}",
        r"(?<![^\s\"'(])(?=[^\s0-9@=:]{0,200}+[0-9@])[^\s\"'<>;,=:]{8,}+",
    ]
)
BEFORE, AFTER = 48, 16
#: Words whose letters count as covered.
DICTIONARY = ("example", "sample", "config", "version", "release", "image", "photo", "index", "page", "user", "name", "file", "data", "test", "assets", "static", "docs", "notes", "report", "model", "draft", "final", "copy", "build", "item", "order", "required", "optional", "none", "null", "true", "false", "default", "change", "your", "here", "value", "field", "input", "string", "number", "button", "primary", "secondary", "header", "footer", "content", "service", "server", "client", "request", "response", "session", "about", "after", "before", "there", "their", "which", "would", "could", "should", "other", "these", "those", "first", "second", "please", "never", "always", "nothing", "something", "password", "secret", "token", "login", "admin", "home", "local", "share", "library", "system", "windows", "linux", "project", "source", "module", "package", "the", "and", "for", "with", "that", "this", "from", "have", "will", "not", "are", "was", "you", "all", "ing", "tion", "ment", "ness", "able")
NAMED = r"(token|secret|passw|pwd|pass|api.?key|access.?key|private.?key|auth|credential|bearer|passphrase)[a-z0-9_]{0,12}[\"']?\s{0,2}[=:]{0,2}>?\s{0,2}[\"']?$"
BENIGN = r"(commit|sha1|sha256|sha512|md5|checksum|digest|hash|uuid|guid|version|revision|etag|isbn|build|fingerprint|phone|tel|fax|card|order|invoice|date|time|path|file|url|href|src|mail|from|class|style|id|ref|tag|branch|image|colou?r|note)[\"']?\s{0,2}[=:]?\s{0,2}[\"']?$"
PLACEHOLDER = r"(?i)x{5,}|\*{4,}|\.{3}|change.?me|your|example|sample|dummy|placeholder|redacted|todo|\$\{|\{\{|%\(|\(\)|environ|getenv|process\.env|config\.|required|none$"
FEATURES = ["length", "changes", "digits", "hex", "upper", "distinct", "covered", "signs", "rhythm", "dotted", "plain", "named", "given", "quoted", "benign", "pathlike", "placeholder", "format", "address", "fixture"]


def _share(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{keep}]", "")) / F.length(text)


def with_features(found: DataFrame, dictionary: tuple[str, ...] = DICTIONARY) -> DataFrame:
    """Adds the feature columns to rows with candidate, before, after and path; nulls count as empty. Whole candidates are read, however long."""
    c = F.coalesce("candidate", F.lit(""))
    safe = F.when(F.length(c) > 0, c).otherwise("-")
    before, path = F.lower(F.coalesce("before", F.lit(""))), F.lower(F.coalesce("path", F.lit("")))
    after = F.coalesce("after", F.lit(""))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(safe, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "-")
    words = "|".join(sorted(dictionary, key=len, reverse=True))
    flag = lambda x: x.cast("double")
    return found.withColumns(
        {
            "length": F.length(safe).cast("double"),
            "changes": F.regexp_count(kinds, F.lit("a(?=[^a])|B(?=[^B])|0(?=[^0])|-(?=[^-])")) / F.length(safe),
            "digits": _share(safe, "0-9"),
            "hex": _share(safe, "0-9a-fA-F"),
            "upper": _share(safe, "A-Z"),
            "distinct": F.size(F.array_distinct(F.split(safe, ""))) / F.length(safe),
            "covered": 1 - F.length(F.regexp_replace(F.lower(safe), words, "")) / F.length(safe),
            "signs": 1 - _share(safe, "0-9A-Za-z"),
            "rhythm": F.regexp_count(F.lower(safe), F.lit("[aeiou](?=[b-df-hj-np-tv-z])")) / F.length(safe),
            "dotted": _share(safe, "./:"),
            "plain": flag(safe.rlike("^[A-Za-z]?[a-z]*[.!?)]?$")),
            "named": flag(before.rlike(NAMED)),
            "given": flag(before.rlike("[=:]\\s{0,2}[\"']?$")),
            "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
            "benign": flag(before.rlike(BENIGN)),
            "pathlike": flag(before.rlike(r"[/.\\@]$") | after.rlike(r"^[/.]?(html|png|jpg|pdf|txt|js|css|com|org)") | safe.rlike(r"^[.~]?/|^www\.|\.[a-z]{2,4}(/|$)|@[a-z0-9-]+\.")),
            "placeholder": flag(safe.rlike(PLACEHOLDER)),
            "format": flag(safe.rlike(f"^(?:{VENDOR}|-----BEGIN)")),
            "address": flag(before.rlike(r"://[^\s/:@]{1,64}:$") & after.startswith("@")),
            "fixture": flag(path.rlike("test|example|sample|fixture|docs?/|readme")),
        }
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, row, nth, start, candidate, before, after, path) of all candidates of whole texts; start counts characters from 0.

    A candidate is, whichever comes first: a private key block; a password of an address (``://name:here@``); a key in a
    vendor's format; six or more characters other than spaces, quotes, ``<>;,`` after ``=`` or ``:``; eight or more
    between quotes; a run of twelve or more key characters with a letter and a digit; eight or more characters (not
    ``=`` or ``:``) after white space, a quote or a bracket, among them a digit or an at sign in the first 200. ``row`` is a hash of text and path.
    Null and empty texts have none; rows with equal or null ids are scanned apart; candidates may be of any length.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path")).where(F.col("text").rlike(CANDIDATE))
    cut = rows.select("doc_id", "path", F.monotonically_increasing_id().alias("uid"), F.xxhash64("text", "path").alias("row"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("between"))
    at = F.transform(
        "found",
        lambda c, i: F.struct(c.alias("candidate"), F.length(F.element_at("between", i + 1)).alias("gap"), _last(F.concat(F.coalesce(F.get("found", i - 1), F.lit("")), F.element_at("between", i + 1)), BEFORE).alias("before"), F.substring(F.element_at("between", i + 2), 1, AFTER).alias("after"), i.alias("nth")),
    )
    each = cut.select("doc_id", "path", "uid", "row", F.explode(at).alias("x")).select("doc_id", "path", "uid", "row", "x.*")
    so_far = Window.partitionBy("uid").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("candidate")).over(so_far) - F.length("candidate")
    return each.select("doc_id", "row", "nth", start.alias("start"), "candidate", "before", "after", "path")


def _last(text: Column, n: int) -> Column:
    return F.substring(text, F.greatest(F.length(text) - n + 1, F.lit(1)), F.lit(n))


def labelled_findings(spark: SparkSession, n: int = 18_000) -> DataFrame:
    """Made-up labelled findings (kind, candidate, before, after, path, is_secret), the same on every call.

    Secrets are random keys, human passwords, key blocks and vendors' formats, mostly after a naming word. Negatives
    have their shapes: digests, identifiers, numbers, times, paths, addresses, plain words and placeholders
    after the same naming words, and secrets in the files of tests and examples.
    """
    draw = lambda salt, count: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count))
    pick = lambda salt, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), draw(salt, len(xs)).cast("int") + 1)
    digest = lambda salt: F.sha2(F.concat_ws("-", "id", F.lit(salt)), 256)
    part = lambda x, n: F.substring(x, 1, n)
    base64 = lambda salt: F.translate(F.base64(F.unhex(digest(salt))), "=", "")
    number = lambda salt, size: F.lpad(draw(salt, 10**size).cast("string"), size, "0")
    letters = F.translate(F.concat(digest("l1"), digest("l2")), "0123456789abcdef", "qwzxkvjprmtlbdgs")
    plain = ("nothing", "required", "whatever", "something", "optional", "between", "morning", "several", "question", "weather", "brother", "paragraph", "holiday", "contents", "national", "kitchen", "yesterday", "important", "Sicherheit", "bonjour", "mañana", "gesehen", "ensuite", "nunca")
    word = lambda salt: pick(salt, *plain)
    title = lambda salt: F.initcap(pick(salt, "tiger", "moon", "river", "coffee", "summer", "purple", "horse", "battery", "correct", "dragon", "hunter", "monkey"))
    sign = lambda salt: pick(salt, "!", "&", "#", "$", "*", "@", "%", "?")
    name = pick("k", 'token = "', "password=", 'api_key: "', "secret = '", "PASSWORD=", 'TOKEN = "', "access_key=", "passwd: ", '"client_secret": "', "auth_token=", "pwd = ")
    same = pick("d", "commit ", "sha1: ", "checksum=", "md5 ", "digest ", 'etag: "', "revision ", "sha256:", "fingerprint: ", "build=")
    ident = pick("i", "id=", "uuid: ", "request_id=", "ref: ", 'id="', "order: ", "guid=", "tag=")
    empty = F.lit("")
    date = F.concat(F.lit("20"), number("y", 2), F.lit("-0"), number("mo", 1), F.lit("-1"), number("dy", 1))
    human = pick("hu", F.concat(F.lower(title("h1")), number("h2", 2)), F.concat(title("h3"), title("h4"), title("h5")), F.concat(title("h6"), sign("h7"), title("h8"), sign("h9"), number("ha", 2)), F.concat(F.lower(title("hb")), sign("hc"), number("hd", 4)), F.concat(title("he"), number("hf", 3), sign("hg")))
    vendor = pick("ve", F.concat(F.lit("AKIA"), part(F.upper(F.translate(base64("v1"), "+/", "7Q")), 16)), F.concat(F.lit("ghp_"), part(F.translate(base64("v2"), "+/", "aZ"), 36)), F.concat(F.lit("xoxb-"), part(letters, 12), F.lit("-"), part(digest("v3"), 16)), F.concat(F.lit("xoxp-"), part(letters, 24)), F.concat(F.lit("sk_live_"), part(digest("v4"), 24)), F.concat(F.lit("eyJ"), part(F.translate(base64("v5"), "+/", "-_"), 24), F.lit(".eyJ"), part(digest("v6"), 30), F.lit("."), part(base64("v7"), 12)))
    block = F.concat(pick("pb", "-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN PRIVATE KEY-----\n"), base64("p1"), F.lit("\n"), base64("p2"), F.lit("\n"), part(base64("p3"), 9), F.lit("==\n-----END PRIVATE KEY-----"))
    key = pick("ky", part(digest("t"), 40), part(digest("w"), 32), F.upper(part(digest("u"), 40)), part(base64("b1"), 40), part(base64("b2"), 24), part(letters, 26), F.concat(part(base64("b3"), 20), F.lit("=")))
    shape = pick("sh", key, part(digest("s1"), 18), part(letters, 32), human)
    placeholder = pick("pl", "changeme", "your-api-key-here", "xxxxxxxxxxxx", "********", "${DB_PASSWORD}", "example123", "os.environ[TOKEN]", "getPassword()", "process.env.SECRET", "placeholder", "{{secret}}", "todo-fill-in", "config.api_key", "redacted")
    path = F.concat(pick("p4", "/usr/lib/", "./src/", "/home/user/", "~/data/"), pick("p5", "report", "model", "image", "index"), number("p6", 3), pick("p7", ".txt", ".png", "/final", ".json"))
    address = pick("ad", F.concat(F.lit("www."), word("a1"), F.lit(".com/"), word("a2"), number("a3", 4)), F.concat(word("a4"), F.lit("."), word("a5"), F.lit("@mail.org")), F.concat(F.lit("//cdn.site.net/"), part(digest("a6"), 8), F.lit(".js")))
    compound = pick("co", F.concat(word("c1"), F.lit("-"), word("c2"), F.lit("-"), number("c3", 4)), F.concat(pick("c4", "img_", "IMG-", "scan", "report-"), number("c5", 8), F.lit("_"), number("c6", 4)), F.concat(F.lit("btn-"), word("c7"), F.lit("-2x")), F.concat(F.lit("v"), number("c8", 1), F.lit("."), number("c9", 2), F.lit(".3-rc4")))
    bare = pick("ba", part(digest("x1"), 40), digest("x2"), part(digest("x3"), 32), F.concat(part(digest("x4"), 7), F.lit("-g"), part(digest("x5"), 8)))
    uuid = F.concat_ws("-", part(digest("y1"), 8), part(digest("y2"), 4), part(digest("y3"), 4), part(digest("y4"), 4), part(digest("y5"), 12))
    kinds: list[tuple[str, Column, Column, int]] = [
        ("named key", key, name, 1),
        ("named key", shape, name, 1),
        ("human password", human, name, 1),
        ("vendor format", vendor, pick("vb", empty, name, F.lit("Authorization: Bearer "), F.lit("see ")), 1),
        ("address password", pick("ap", human, part(digest("q1"), 16), part(letters, 12)), F.concat(pick("as", "postgres://", "mysql://", "https://", "redis://"), pick("au", "admin", "app", "root"), F.lit(":")), 1),
        ("private key", block, pick("pk", empty, F.lit("key:\n"), F.lit("\n")), 1),
        ("digest", pick("di", part(digest("z1"), 40), digest("z2"), part(digest("z3"), 32), part(base64("z4"), 43)), same, 0),
        ("bare digest", bare, pick("bb", empty, F.lit("/"), F.lit("("), F.lit('"')), 0),
        ("identifier", pick("id", uuid, part(digest("i1"), 24), F.concat(F.lit("ORD-"), number("i2", 10)), part(F.upper(digest("i3")), 12)), ident, 0),
        ("number", pick("nu", F.concat(F.lit("+49-"), number("n1", 4), F.lit("-"), number("n2", 6)), F.concat(F.lit("41"), number("n3", 14)), F.concat(F.lit("978-3-"), number("n4", 6)), number("n5", 12)), pick("nb", "tel: ", "phone=", "card: ", "isbn: ", "invoice: ", "fax: "), 0),
        ("time", F.concat(date, F.lit("T"), number("t1", 2), F.lit(":30:"), number("t2", 2), F.lit("Z")), pick("tb", "date: ", "time=", 'created="', "at: "), 0),
        ("path", path, pick("pa", "path=", "file: ", 'src="', "path: '"), 0),
        ("link or mail", address, pick("lb", "url: ", "mail: ", 'href="', "from: ", "see: "), 0),
        ("plain word", pick("pw", word("w1"), F.initcap(word("w2")), F.concat(word("w3"), F.lit(".")), F.concat(word("w4"), word("w5"))), pick("wb", F.lit("note: "), F.lit("that: "), F.lit("said: '"), F.lit('"'), name), 0),
        ("placeholder", placeholder, name, 0),
        ("compound", compound, pick("cb", empty, F.lit('class="'), F.lit("/assets/"), F.lit("see "), F.lit("version: ")), 0),
        ("in a fixture", pick("fx", key, human), name, 0),
        ("named key", key, name, 1),
    ]
    prose = F.concat(word("b1"), F.lit(" "), pick("b2", "the", "der", "une", "los", "of", "and"), F.lit(" "), word("b3"), F.lit(" "))

    def rows(i: int, kind: str, candidate: Column, before: Column, secret: int) -> DataFrame:
        quote = F.when(before.endswith('"'), '" ').when(before.endswith("'"), "' ").otherwise(pick("qu", " ", "\n", "; ", ", "))
        fixture = draw("pp", 20) < (20 if kind == "in a fixture" else 1)
        place = F.when(fixture, pick("fp", "tests/data", "docs/readme", "example/a", "fixtures/b.json", "sample.env")).otherwise(pick("sr", "src0", "src7", "lib/a", "web/b", "", "conf/app.ini"))
        after = F.concat(F.lit("@db.host.net/") if kind == "address password" else quote, word("af"))
        ids = spark.range(i, n, len(kinds), 1)
        return ids.select(F.lit(kind).alias("kind"), candidate.alias("candidate"), F.concat(prose, before).alias("before"), after.alias("after"), place.alias("path"), F.when(fixture, 0).otherwise(secret).alias("is_secret"))

    return reduce(DataFrame.unionByName, [rows(i, *kind) for i, kind in enumerate(kinds)])


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(found))


def train(findings: DataFrame, trees: int = 30, depth: int = 10, most: int = 20_000, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings (candidate, before, after, path, is_secret); a documented bound of ``most`` rows with the smallest hashes is used. Rows without a label are left out. The model can be saved and loaded as any of Spark's."""
    rows = findings.where(F.col("is_secret").isNotNull()).orderBy(F.xxhash64("candidate", "before"), "candidate", "before").limit(most)
    # written once, since fitting reads its rows several times
    rows = materialize(_vectors(rows).select("features", F.col("is_secret").cast("double").alias("label")), "findings")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


_fitted: dict[str, RandomForestClassificationModel] = {}


def default_forest(spark: SparkSession) -> RandomForestClassificationModel:
    """The forest of ``labelled_findings``, fitted once per application."""
    name = spark.sparkContext.applicationId
    if name not in _fitted:
        _fitted.clear()
        _fitted[name] = train(labelled_findings(spark))
    return _fitted[name]


def scan(docs: DataFrame, forest: RandomForestClassificationModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """All candidates with the forest's verdict: (doc_id, row, nth, start, candidate, path, chance, is_secret)."""
    found = _vectors(candidates(docs, id_col, text_col, path_col))
    judged = forest.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("probability").transform(found)
    chance = F.element_at(vector_to_array("probability"), 2)
    return judged.select("doc_id", "row", "nth", "start", "candidate", "path", chance.alias("chance")).withColumn("is_secret", F.col("chance") >= threshold)


def redact(docs: DataFrame, forest: RandomForestClassificationModel, threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every secret in text replaced by ``mask`` (n_chars follows); all rows and columns stay.

    Null and empty texts, and texts without a secret, pass unchanged; repeated rows are each masked. The secrets found are
    written once; Spark sends them to the texts while they are small, and joins by the texts' hashes beyond that.
    """
    found = materialize(scan(docs, forest, threshold).where("is_secret").groupBy("row").agg(F.collect_set("nth").alias("masked")), "secrets")
    touched = docs.withColumn("row", F.xxhash64(F.col("text").cast("string"), F.col("source").cast("string"))).join(found.withColumnRenamed("row", "at"), F.col("row") == F.col("at"), "left")
    kept = F.transform(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), lambda c, i: F.when(F.array_contains("masked", i), F.lit(mask)).otherwise(c))
    text = F.array_join(F.zip_with(F.split("text", CANDIDATE, -1), kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    touched = touched.withColumn("text", F.when(F.col("masked").isNotNull(), text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.when(F.col("masked").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return touched.select(*docs.columns)
