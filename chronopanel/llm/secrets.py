"""Secret scan: candidate strings by shape and place, and a random forest on labelled findings that removes the false ones.

A candidate is a run of SHORTEST or more letters, digits and + / _ - with up to two = at its end; three such runs with dots between
that begin like a signed token; or, right after a name with an asking word (password, token, …) and an assignment, any SHORT or more
characters up to a space, quote or comma, so short passwords and those with punctuation are candidates too. A name in an assignment is none. Features: its length, shares of
digits, capitals, punctuation and distinct characters, the share of neighbouring characters of different classes, the share that dictionary
words and frequent letter groups cover, whether the path looks like tests or examples, and what stands beside it: a word
such as password or token before it, a word such as commit or checksum, an assignment or a quote, a scheme or slash of
an address. Neighbouring candidates are part of what stands beside one. Candidates are cut out by regular expressions over whole texts; the
forest is Spark's own. Only DataFrame functions run.

Where a caller has no labelled findings, :func:`scan` trains on two kinds. :func:`corpus_findings` are those of the scanned documents themselves
that a rule settles, a bounded sample of the first by hash: hex or mixed strings assigned to an asking word in quotes are secrets, and runs of
letters only that nothing asks for are none. :func:`labelled_findings` are made up, for shapes and contexts that a corpus may lack. The decision is
the forest's alone, for settled ones as well.

Nulls, ties, and so on: null and empty texts have no candidates; a null path looks like no test; a null id is kept; equal
candidates at several places are separate findings; repeated rows are reported each; very long texts are searched to their end; an empty table gives an empty
result; without findings of both labels training fails with Spark's message; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from chronopanel.sources.tables import written

SHORTEST, SHORT = 16, 8
ASKING = r"pass(?:word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private[_-]?key"
#: An asking word, the rest of its name and an assignment, up to where the value begins.
ASKED = rf"(?=[AaBbCcPpSsTt])(?i:{ASKING})[A-Za-z0-9_-]{{0,20}}[\"']?[\x20\t]{{0,3}}[:=][\x20\t]{{0,3}}[\"']?"
VALUE = rf"[^\s\"'<>,;]{{{SHORT},}}"
SIGNED = r"(?<![A-Za-z0-9+/_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?"
#: A run that isn't the name in an assignment.
RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST},}}+(?:={{1,2}}(?![A-Za-z0-9+/_\"'-])|(?![\"']?[\x20\t]{{0,3}}[:=]))"
CANDIDATE = f"{ASKED}{VALUE}|{SIGNED}|{RUN}"
#: Characters of text before and after a candidate that features look at.
BEFORE, AFTER = 48, 24
FINDINGS, SETTLED, TREES, DEPTH = 6000, 2000, 20, 8
#: Words and letter groups that random strings rarely hold.
DICTIONARY = ("password", "example", "placeholder", "changeme", "token", "secret", "test", "the", "and", "ing", "ion", "ent", "ati", "her", "ter", "est", "ers", "ver", "all", "ght", "tion", "ment", "sch", "ung", "ein", "ich", "eit", "lich", "heit", "que", "eau", "oui", "aux", "elle", "con", "ado", "cion", "mente", "los", "por", "para", "are", "ere", "ith", "for", "was", "com", "org", "www", "http", "index", "html", "ea", "ou", "th", "er", "on", "an", "re", "in", "st", "en", "ti", "or", "le", "de", "se", "be", "ge", "ch", "un", "la", "es", "os", "as", "al")
KEYWORD = rf"(?i)({ASKING})[A-Za-z0-9_-]{{0,20}}[^A-Za-z0-9]{{0,6}}$"
BENIGN = r"(?i)(commit|checksum|sha\d*|md5|digest|etag|revision|uuid|guid|hash|build|version|id)[^A-Za-z0-9]{0,6}$"
ADDRESS = r"(?i)(https?:|www\.|\.[a-z]{2,4}/|[a-z]/)[^\s]*$"
FEATURES = ("length", "digits", "capitals", "marks", "distinct", "transitions", "covered", "test_path", "keyword", "benign", "assigned", "quoted", "address", "key_shape")


def features(candidate: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Features of a candidate by name."""
    n = F.length(candidate).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(candidate, pattern, "")) / n
    changes = F.length(F.regexp_replace(candidate, r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])", "#")) - F.length(candidate)
    uncovered = F.length(F.regexp_replace(F.lower(candidate), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "length": n,
        "digits": share("[^0-9]"),
        "capitals": share("[^A-Z]"),
        "marks": share("[A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / n,
        "transitions": changes / n,
        "covered": 1 - uncovered / n,
        "test_path": flag(path.rlike(r"(?i)(^|[/_.-])(tests?|fixtures?|examples?|samples?|docs?)([/_.-]|$)")),
        "keyword": flag(before.rlike(KEYWORD)),
        "benign": flag(before.rlike(BENIGN)),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
        "address": flag(before.rlike(ADDRESS)),
        "key_shape": flag(candidate.rlike(r"^(AKIA|ASIA)[A-Z2-7]{16}$|^(ghp|gho|sk|pk|xox[bp])[_-]|^eyJ[A-Za-z0-9_-]+\\.")),
    }


def labelled_findings(spark: SparkSession, n: int = FINDINGS, seed: int = 11) -> DataFrame:
    """n findings (candidate, before, after, path, label): half of them secrets, by seeded hashes of their numbers."""
    rows = spark.range(n)
    h = lambda salt: F.sha2(F.concat_ws("|", F.lit(seed), F.lit(salt), F.col("id")), 256)
    pick = lambda salt, values: F.get(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(len(values))).cast("int"))
    hexes = [F.substring(h("x"), 1, k) for k in (18, 20, 24, 32, 40, 64)]
    coded = [F.substring(F.regexp_replace(F.base64(F.unhex(h("b"))), "[=]", ""), 1, k) for k in (20, 24, 32, 40)]
    key = F.concat(F.lit("AKIA"), F.translate(F.upper(F.substring(h("k"), 1, 16)), "0189ABCDEF", "QZJKWXYTVU"))
    prefixed = F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(F.base64(F.unhex(h("g"))), "[+/=]", "x"), 1, 36))
    uuid = F.concat_ws("-", *[F.substring(h("u"), a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    word = lambda k: F.concat(*[pick(f"w{k}{i}", DICTIONARY[5:]) for i in range(k)])
    fillers = ["", "The of and ", "const ", "set ", "mit der ", "# ", "que la "]
    asks = ["password=", "token = \"", "secret: ", "api_key='", "Authorization: Bearer ", "passwd: ", "access_key="]
    harmless = ["commit ", "sha256:", "checksum=", "uuid: ", "etag ", "build id=", "revision "]
    plain = ["", "with ", "the ", "in ", "und ", "para "]
    links = ["https://example.org/", "see www.example.com/a/", "href=http://x.net/p/"]
    secret = F.pmod(F.xxhash64(F.lit(seed), F.lit("label"), "id"), F.lit(2)) == 1
    kind = F.pmod(F.xxhash64(F.lit(seed), F.lit("kind"), "id"), F.lit(10))
    short = F.concat(F.substring(F.regexp_replace(F.base64(F.unhex(h("s"))), "[+/=]", ""), 1, 7), pick("m", ["!", "#", "9$", ".x", "%2", "-7", "@", ""]), F.substring(h("t"), 1, 3))
    shape = F.when(kind < 3, pick("hex", hexes)).when(kind < 4, short).when(kind < 6, pick("coded", coded)).when(kind < 9, key).otherwise(prefixed)
    # keys of a known shape are secrets wherever they stand; others by the word before them
    secret_before = F.when((kind >= 6) & (kind < 8), pick("p", plain)).otherwise(pick("a", asks))
    fake = F.when(kind < 4, pick("words", [word(k) for k in (6, 8, 10, 12)])).when(kind < 5, F.repeat(pick("c", ["x", "a", "-", "0", "ab", "_"]), 20)).when(kind < 7, pick("hex", hexes)).when(kind < 8, uuid).when(kind < 9, pick("told", [word(3), word(4), word(5)])).otherwise(F.concat_ws("/", word(3), word(4), word(2)))
    fake_before = F.when(kind < 4, pick("p", plain)).when(kind < 5, pick("a", asks)).when(kind < 8, pick("h", harmless)).when(kind < 9, pick("b", asks)).otherwise(pick("l", links))
    made = rows.select(
        "id",
        F.when(secret, shape).otherwise(fake).alias("candidate"),
        F.concat(pick("f", fillers), F.when(secret, secret_before).otherwise(fake_before)).alias("before"),
        secret.cast("double").alias("label"),
        F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit("path"), "id"), F.lit(10)) == 0, "tests/fixtures").otherwise("src").alias("path"),
    )
    quote = F.regexp_extract("before", r"([\"'])$", 1)
    return made.withColumn("after", F.concat(quote, pick("e", [" ", ". The", "\n", ", and"]))).drop("id")


def train(findings: DataFrame, seed: int = 11) -> RandomForestClassificationModel:
    """The forest for findings (candidate, before, after, path, label)."""
    own = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(findings.select("label", *[c.alias(k) for k, c in own.items()]))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, labelCol="label").fit(table)


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """doc_id, path, nth, candidate, gap (characters since the end of the one before it), before, after of every candidate of every text."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(CANDIDATE), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"), found.alias("found")).where(F.size("found") > 0)
    rows = rows.withColumn("between", F.split("text", CANDIDATE, -1))
    # what is beside a candidate holds its neighbours too, of which a few fill the width
    piece, word = (lambda i: F.coalesce(F.get("between", i), F.lit(""))), (lambda i: F.coalesce(F.get("found", i), F.lit("")))
    left = lambda i: F.concat(*[x for k in range(-(-BEFORE // SHORT), 0, -1) for x in (word(i - k), piece(i - k + 1))])
    right = lambda i: F.concat(*[x for k in range(1, -(-AFTER // SHORT) + 1) for x in (piece(i + k), word(i + k))])
    # where a name and an assignment were found with their value, only the value is the candidate
    lead = lambda c: F.regexp_extract(c, f"^{ASKED}(?={VALUE}$)", 0)
    beside = F.transform("found", lambda c, i: F.struct(i.alias("nth"), c.alias("whole"), lead(c).alias("lead"), F.length(F.get("between", i)).alias("gap"), left(i).alias("left"), right(i).alias("right")))
    rows = rows.select("doc_id", "path", F.explode(beside).alias("x")).select("doc_id", "path", "x.*")
    before, candidate = F.concat("left", "lead"), F.expr("substring(whole, length(lead) + 1)")
    return rows.select("doc_id", "path", "nth", candidate.alias("candidate"), (F.col("gap") + F.length("lead")).alias("gap"), F.right(before, F.lit(BEFORE)).alias("before"), F.left("right", F.lit(AFTER)).alias("after"))


def corpus_findings(found: DataFrame, most: int = SETTLED) -> DataFrame:
    """Of candidates (:func:`candidates`), ``most`` of each label that a rule settles, the first by a hash of what they are: candidate, before, after, path, label."""
    asked = F.col("before").rlike(rf"(?i)({ASKING})[A-Za-z0-9_-]{{0,20}}\s*[:=]\s*[\"']$") & F.col("candidate").rlike(r"^(?=.*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}$") & F.col("after").rlike(r"^[\"']")
    plain = F.col("candidate").rlike(r"^[A-Za-z]+$") & ~F.col("before").rlike(KEYWORD)
    settled = found.withColumn("label", F.when(asked, 1.0).when(plain, 0.0)).where("label is not null").select("candidate", "before", "after", "path", "label")
    order = F.sha2(F.concat_ws("|", "candidate", "before", "after", "path"), 256)
    one = lambda label: settled.where(F.col("label") == label).orderBy(order, "candidate", "before", "after", "path").limit(most)
    return one(1.0).unionByName(one(0.0))


def scan(docs: DataFrame, *, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """Per candidate: doc_id, nth, gap (characters since the one before it), candidate, score, is_secret."""
    rows = written(candidates(docs, id_col, text_col, path_col), "secret-candidates", keep=True)
    if findings is None:
        made = labelled_findings(docs.sparkSession)
        findings = made.unionByName(corpus_findings(rows).select(*made.columns))
    model = train(findings)
    own = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.select("doc_id", "nth", "gap", "candidate", *[c.alias(k) for k, c in own.items()]))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 9)
    return model.transform(table).select("doc_id", "nth", F.col("gap").cast("long").alias("gap"), "candidate", score.alias("score"), (score >= threshold).alias("is_secret"))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """All candidates of all documents with their scores; candidates themselves as hashes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return scan(docs).select("doc_id", "nth", "gap", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
