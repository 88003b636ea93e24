"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Three patterns find assignments, access keys and long hex strings. Beyond them, every token of `TOKEN_CHARS`
characters or more is scored by the mean log-likelihood ratio of its character pairs under a model of random strings and
one of ordinary identifiers; the ratio alone decides, against a threshold that is higher for shorter tokens. The models are
trained from labelled samples of bounded size: `RANDOM_SAMPLES` generated strings over the alphabets that secrets are
written in; and, as ordinary, what identifiers look like, spelled by the rules of code (paths, slugs, snake and camel
case, constants, dates and versions, long numbers) from the words of about `TRAINING_DOCS` documents, those by their hash, and from
a list of words that code is made of, the distinct words of 8 to 19 characters of those documents that no pattern takes, and one
character repeated, of each kind. A pair's chance falls back on its second character's. A model that has been fitted once can
be given to any number of scans.

All of it is DataFrame expressions. Spans count code points, end exclusive.

Defined results: a null text is empty; repeated rows get equal results; an empty
table gives an empty table; extra columns do not matter; spans of equal start are
ordered as assign, access, hex, model; a token that overlaps a pattern's span is
not scored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.columns import chars, let, matches

# fixed values: the base patterns, and how long a match (of the second group, for assign) must be
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

TOKEN_CHARS = 12
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{TOKEN_CHARS},}}"  # no shorter run can hold an access key or a hex string
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,19}(?![A-Za-z0-9+/_=-])"
SIZE = len(ALPHABET) + 1
RANDOM_SAMPLES, RANDOM_CHARS, FILLERS, FILLER_CHARS = 8_000, 32, 20, 64
#: Documents whose words train the model of ordinary identifiers; tables with fewer are used whole.
TRAINING_DOCS = 20_000
HEX_DIGITS, LETTERS = "0123456789abcdef", ALPHABET[:52]
RANDOM_ALPHABETS = (
    HEX_DIGITS, HEX_DIGITS.upper(), ALPHABET[:64], ALPHABET[:62] + "-_", ALPHABET[:62], ALPHABET[:26] + "0123456789",
    ALPHABET[26:52] + "0123456789", LETTERS
)
#: Mean log-likelihood ratio a pair (natural logarithm) from which a token counts as random: for LONG_CHARS characters or more, and what each one less adds.
LEAST_RATIO, LONG_CHARS, SHORT_RATIO = 1.0, 20, 0.04
#: Identifiers spelled from the list of words; of a document's words, one run in so many is spelled.
CODE_SAMPLES, NUMBER_SAMPLES, RUN_STEP = 12_000, 800, 6

# fixed values: words that identifiers are often made of
CODE_WORDS = """
    access account action address agent alias apply array asset async audio base batch block body border bridge browser buffer build button cache
    call cancel capture channel char check child class client clock cloud code collection color command compile connect console const content
    control copy core count create current cursor daemon data debug decode delete deploy depth device digest disk display domain driver dynamic
    edit element enable engine entry error event example execute export factory field filter final first float folder font frame front gateway
    global graph group guide hash header health hidden history host image import index init inner insert instance invoke item java job join
    kernel label last layer layout level library limit line link list load local lock login loop main mark mask matrix media member memory menu
    merge meta metric mock mode module mount mouse native network next node null object offset open option order org output owner page panel
    parse part patch path payload pixel plugin point pool port post prefix print private profile prompt proxy public queue quick range raw read
""".split()

NO_SPANS = "array<struct<start:int,end:int,match:string>>"


def long_tokens(text: Column) -> Column:
    return matches(text, TOKEN)


def base_spans(text: Column, tokens: Column) -> dict[str, Column]:
    """kind to spans; match holds the secret. tokens: the text's long_tokens, wherein access keys and hex strings lie."""

    def inside(pattern: str) -> Column:
        moved = lambda t: F.transform(
            matches(t["match"], pattern),
            lambda x: F.struct((t["start"] + x["start"]).alias("start"), (t["start"] + x["end"]).alias("end"), x["match"].alias("match"))
        )
        return F.when(F.exists(tokens, lambda t: t["match"].rlike(pattern)), F.flatten(F.transform(tokens, moved))).otherwise(F.array().cast(NO_SPANS))

    return {
        "assign": F.filter(matches(text, ASSIGN, 2), lambda x: F.length(x["match"]) >= ASSIGN_CHARS),
        "access": F.filter(inside(ACCESS), lambda x: F.length(x["match"]) >= ACCESS_CHARS),
        # a run of hex characters is one match, so asking for its length at once finds the same
        "hex": inside(r"(?<![0-9a-f])" + HEX.replace("+", f"{{{HEX_CHARS},}}")),
    }


def random_strings(spark: SparkSession, n: int = RANDOM_SAMPLES) -> DataFrame:
    """Generated samples of random strings, label 1."""
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    byte = lambda h, i: F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    alphabet = F.element_at(F.array(*map(F.lit, RANDOM_ALPHABETS)), (F.col("id") % len(RANDOM_ALPHABETS) + 1).cast("int"))
    spelled = F.transform(
        F.sequence(F.lit(0), F.lit(RANDOM_CHARS - 1)),
        lambda i: F.substr(F.col("alphabet"), byte(F.col("digest"), i) % F.length("alphabet") + 1, F.lit(1))
    )
    return spark.range(n).select(digest.alias("digest"), alphabet.alias("alphabet")).select(F.array_join(spelled, "").alias("token"), F.lit(1).alias("label"))


def fillers(spark: SparkSession) -> DataFrame:
    """Samples of rules and placeholders, one character again and again, label 0; as many as outweigh the character's other neighbours."""
    return spark.range(FILLERS * len(ALPHABET)).select(
        F.repeat(F.substr(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1)), F.lit(FILLER_CHARS)).alias("token"),
        F.lit(0).alias("label")
    )


def identifier(words: Column, form: Column) -> Column:
    """Words (small letters) spelled as code spells them, in one of eight forms."""
    title = F.transform(words, F.initcap)
    return F.get(
        F.array(
            F.array_join(words, "/"), F.array_join(words, "-"), F.array_join(words, "_"), F.concat(F.get(words, F.lit(0)), F.array_join(F.slice(title, F.lit(2), F.size(words)), "")),
            F.array_join(title, ""), F.upper(F.array_join(words, "_")), F.concat(F.lit("20"), F.lpad((F.size(words) * 7 + F.length(F.get(words, F.lit(0)))).cast("string"), 2, "0"), F.lit("-01-05-"), F.array_join(words, "-"), F.lit("-v"), F.size(words).cast("string")),
            F.concat(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), "/"), F.lit("/"), F.element_at(title, -1), F.element_at(title, 1)),
        ),
        form,
    )


def code_identifiers(spark: SparkSession, n: int = CODE_SAMPLES) -> DataFrame:
    """Samples of identifiers from the list of words, label 0."""
    digest = F.sha2(F.concat(F.lit("code"), F.col("id").cast("string")).cast("binary"), 256)
    number = lambda i: F.conv(F.substr("digest", 4 * i + 1, F.lit(4)), 16, 10).cast("int")
    words = F.transform(F.sequence(F.lit(1), (F.col("id") % 4 + 2).cast("int")), lambda i: F.get(F.array(*map(F.lit, CODE_WORDS)), number(i) % len(CODE_WORDS)))
    rows = spark.range(n).select("id", digest.alias("digest")).select("id", words.alias("words"))
    return rows.select(identifier(F.col("words"), (F.col("id") / 4 % 8).cast("int")).alias("token"), F.lit(0).alias("label"))


def long_numbers(spark: SparkSession, n: int = NUMBER_SAMPLES) -> DataFrame:
    """Samples of numbers of 12 to 27 digits, label 0: they are ids, accounts and times."""
    digest = F.sha2(F.concat(F.lit("number"), F.col("id").cast("string")).cast("binary"), 512)
    digit = lambda i: (F.conv(F.substr("digest", 4 * i + 1, F.lit(4)), 16, 10).cast("int") % 10).cast("string")
    rows = spark.range(n).select("id", digest.alias("digest"))
    spelled = F.transform(F.sequence(F.lit(0), (F.col("id") % 16 + 11).cast("int")), digit)
    return rows.select(F.array_join(spelled, "").alias("token"), F.lit(0).alias("label"))


def text_identifiers(rows: DataFrame) -> DataFrame:
    """Identifiers from runs of the texts' own words (column text), each distinct one once, label 0."""
    words = rows.select(F.transform(F.regexp_extract_all("text", F.lit("(?<![A-Za-z])[A-Za-z]{2,12}(?![A-Za-z])"), F.lit(0)), F.lower).alias("words")).where(F.size("words") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: i % RUN_STEP == 0)
    runs = words.select(F.explode(F.transform(starts, lambda i: F.struct(F.slice("words", i + 1, i % 4 + 2).alias("words"), (i / RUN_STEP % 8).cast("int").alias("form")))).alias("r"))
    return runs.select(identifier(F.col("r.words"), F.col("r.form")).alias("token")).distinct().withColumn("label", F.lit(0))


def sampled(docs: DataFrame, doc_id: str, text: str, most: int) -> DataFrame:
    """About most rows, chosen by a hash of their id and text; all where there are no more."""
    n = docs.count()
    return docs if n <= most else docs.where(F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 40)) < int((1 << 40) * most / n))


def labelled_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = TRAINING_DOCS) -> DataFrame:
    """token, label (1 random): the words of about most documents and identifiers made of them, each distinct one once, identifiers of
    the list of words, fillers, and the generated random strings."""
    rows = sampled(docs, doc_id, text, most).select(F.col(text).alias("text"), long_tokens(F.col(text)).alias("tokens"))
    known = F.transform(F.flatten(F.array(*base_spans(F.col("text"), F.col("tokens")).values())), lambda x: x["match"])
    words = rows.select(F.explode(F.array_except(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), known)).alias("token")).distinct()
    spark = docs.sparkSession
    ordinary = words.withColumn("label", F.lit(0)).unionByName(text_identifiers(rows)).unionByName(code_identifiers(spark)).unionByName(long_numbers(spark)).unionByName(fillers(spark))
    return ordinary.unionByName(random_strings(spark))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = TRAINING_DOCS) -> list[float]:
    """A model for scan; its size does not depend on the input's."""
    return train(labelled_tokens(docs, doc_id, text, most))


def place(char: Column) -> Column:
    """A character's number in the alphabet; 0 for any other, and for the token's ends."""
    return F.instr(F.lit(ALPHABET), char)


def train(tokens: DataFrame, back: float = 8.0) -> list[float]:
    """The log-likelihood ratios of all character pairs, row by row; SIZE * SIZE numbers whatever the input's size.

    back: how many pairs the second character's own chance weighs.
    """
    coded = tokens.select("label", F.transform(chars(F.col("token")), place).alias("codes"))
    ends = F.array(F.lit(0))
    pairs = coded.select("label", F.explode(F.zip_with(F.concat(ends, "codes"), F.concat("codes", ends), lambda a, b: a * SIZE + b)).alias("pair"))
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    logs = []
    for label in (1, 0):
        rows = [[counts.get((label, a * SIZE + b), 0) for b in range(SIZE)] for a in range(SIZE)]
        single = [sum(row[b] for row in rows) + 0.5 for b in range(SIZE)]
        single = [x / sum(single) for x in single]
        logs.append([math.log((row[b] + back * single[b]) / (sum(row) + back)) for row in rows for b in range(SIZE)])
    return [one - zero for one, zero in zip(*logs, strict=True)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's character pairs, its ends included."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    codes = F.transform(chars(token), place)

    def score(v: Column) -> Column:
        pairs = F.zip_with(F.concat(F.array(F.lit(0)), v), F.concat(v, F.array(F.lit(0))), lambda a, b: F.get(table, a * SIZE + b))
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (F.size(v) + 1)

    return let(codes, score)


def is_random(token: Column, model: list[float]) -> Column:
    """Whether the ratio reaches what a token of this length needs."""
    return ratio(token, model) >= LEAST_RATIO + SHORT_RATIO * F.greatest(F.lit(0), LONG_CHARS - F.length(token))


def tag(kind: str, order: int) -> Column:
    return F.transform(
        kind,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end"),
            x["match"].alias("match")
        )
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: list[float] | None = None) -> DataFrame:
    """doc_id and spans: start, kind, end, match, in order; kinds assign, access, hex, model. model: as from fit, else fitted to docs."""
    model = fit(docs, doc_id, text) if model is None else model
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", long_tokens(F.col("text")).alias("tokens"))
    rows = rows.select("doc_id", "tokens", *(v.alias(k) for k, v in base_spans(F.col("text"), F.col("tokens")).items()))
    # access keys and hex strings lie wholly inside a token, so the token's own text tells; only assignments need their places
    told = lambda t: t["match"].rlike(f"AKIA[A-Z0-9]{{{ACCESS_CHARS - 4},}}|[0-9a-f]{{{HEX_CHARS},}}")
    free = F.filter("tokens", lambda t: ~told(t) & ~F.exists("assign", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    odd = F.filter(free, lambda t: is_random(t["match"], model))
    rows = rows.withColumn("model", F.when(F.size("tokens") > 0, odd).otherwise(F.array().cast(NO_SPANS)))
    tagged = [tag(kind, i) for i, kind in enumerate(("assign", "access", "hex", "model"))]
    return rows.select("doc_id", F.array_sort(F.concat(*tagged)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6(docs: DataFrame) -> DataFrame:
    rows = scan(docs)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "model")
    return rows.select(
        "doc_id", *map(count, ("assign", "access", "hex", "model")), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans")
    )
