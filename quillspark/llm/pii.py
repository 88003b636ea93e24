"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A match that validates (a check sum, a calendar, a range) is permuted within its own
format by a keyed Feistel network over its symbols: card numbers stay card numbers
with a right check digit, dates stay dates, separators stay where they are. The
permutation depends on the key, the kind and the length alone, so equal values get
equal pseudonyms in all documents, different values get different ones, and who
holds the key can turn them back. A slash date that reads as day/month is permuted
among all days, one that only reads as month/day among those that only read so.

A run of numbers is split at its spaces and hyphens, however long it is; whatever in it is written as a card number, an
IBAN, a date or a phone number usually is and validates is found. What runs on in letters or decimals is no number.

The network splits the symbols into two halves; each round adds to one half, symbol
by symbol and modulo the symbol's own radix, a stream made by SHA-256 from the key,
the round and the other half. All of it is column expressions.

Defined results: a null text stays null and has no matches; what does not validate
stays as it is; repeated rows get equal results; an empty table gives an empty
table; other columns stay as they are, also one named as the report would be (the
report then gets an underscore). Dates from 1800 to 2199 are permuted among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.columns import chars, let
from quillspark.llm.common import fresh

ROUNDS = 10
#: The key of op7, whose results anybody may check. It hides nothing: pass a secret key of your own to pseudonymise.
DEMO_KEY = "demonstration"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

#: Letters of other alphabets that are permuted among themselves; letters of further scripts stay.
ALPHABETS = (
    "".join(map(chr, (*range(0xDF, 0xF7), *range(0xF8, 0x100)))), "".join(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xDF)))), "".join(map(chr, range(0x100, 0x180))),
    "".join(map(chr, range(0x3B1, 0x3CA))), "".join(map(chr, (*range(0x391, 0x3A2), *range(0x3A3, 0x3AA)))), "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))),
)
#: What may stand before the @ of an address: letters of any script, digits and four signs.
NAME = r"A-Za-z0-9._%+\-\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u167F\u1681-\u1FFF\u2C00-\u2DFF\u3040-\uD7FF\uF900-\uFDFF"

#: Alternatives in the order in which they are tried at a place. Repeats of a group are bounded or possessive: Java's matcher recurses
#: once a repeat on others, and a long domain would overflow its stack. A run of numbers is taken whole, with what sticks to its end.
PATTERNS = {
    "email": rf"(?<![{NAME}])[{NAME}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,16}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}\x20?\([0-9]{1,4}\)\x20?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])|(?<![\w+(])\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
    r"|(?<![\w+])\+[0-9]{1,3}(?:[\x20-][0-9]{2,8}){2,4}(?![0-9])|(?<![\w.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "date": r"(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9])|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-]))",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "card": r"(?<![\w.-])[0-9](?:[\x20-]?[0-9]){12,}+(?:[\w-]|\.[0-9])*+",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Card numbers as they are written.
CARD_SHAPES = r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}(?:[\x20-][0-9]{3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5})$"
#: Lengths of IBANs by country; those of other countries may have any length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH DE GB GE IE ME RS",
    23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS", 27: "FR GR IT MC SM", 28: "AL AZ CY DO HU LB PL", 29: "BR QA", 30: "KW MU", 31: "MT",
}
#: Every pattern needs one of these; most texts have none.
HINT = r"@|[0-9]{2}|[0-9][./-]"


def permute(symbols: Column, radices: Column, tweak: Column, key: str, back: bool = False) -> Column:
    """The symbols (ints, each below its radix) permuted; back undoes it."""
    half = (F.size(symbols) / 2).cast("int")
    rest = F.size(symbols) - half
    parts = lambda v: (F.slice(v, F.lit(1), half), F.slice(v, half + 1, rest))

    def mix(half_: Column, other: Column, radix: Column, turn: Column, tweak_: Column) -> Column:
        name = F.sha2(F.concat_ws("|", F.lit(key), tweak_, turn.cast("string"), F.array_join(other.cast("array<string>"), ",")), 256)

        def add(h: Column) -> Column:
            stream = lambda i: F.when(i < 16, h).otherwise(F.sha2(F.concat_ws("|", h, F.floor(i / 16).cast("string")), 256))
            step = lambda i: F.conv(F.substr(stream(i), 1 + 4 * (i % 16), F.lit(4)), 16, 10).cast("int")
            return F.transform(half_, lambda x, i: F.pmod(x - step(i) if back else x + step(i), F.get(radix, i)))

        return let(name, add)

    def run(v: Column) -> Column:
        (a, b), (ra, rb) = (v["a"], v["b"]), (v["ra"], v["rb"])
        turns = F.array(*(F.lit(i) for i in (reversed(range(ROUNDS)) if back else range(ROUNDS))))

        def turn(s: Column, k: Column) -> Column:
            first = F.struct(mix(s["a"], s["b"], ra, k, v["tweak"]).alias("a"), s["b"].alias("b"))
            second = F.struct(s["a"].alias("a"), mix(s["b"], s["a"], rb, k, v["tweak"]).alias("b"))
            return F.when(k % 2 == 0, first).otherwise(second)

        return F.aggregate(turns, F.struct(a.alias("a"), b.alias("b")), turn, lambda s: F.concat(s["a"], s["b"]))

    (a, b), (ra, rb) = parts(symbols), parts(radices)
    return let(F.struct(a.alias("a"), b.alias("b"), ra.alias("ra"), rb.alias("rb"), tweak.alias("tweak")), run)


def permute_text(text: Column, kind: str, key: str, back: bool = False, classes: tuple[str, ...] = ()) -> Column:
    """Characters permuted within their class (by default small and capital letters of ASCII, and digits); others stay."""
    classes = classes or (LOWER, UPPER, DIGITS)

    def run(cs: Column) -> Column:
        number, radix = F.lit(0), F.lit(1)
        value = lambda c: F.coalesce(*(F.when(F.contains(F.lit(x), c), F.instr(F.lit(x), c) - 1) for x in classes), number)
        size = lambda c: F.coalesce(*(F.when(F.contains(F.lit(x), c), F.lit(len(x))) for x in classes), radix)
        spell = lambda c, n: F.coalesce(*(F.when(F.contains(F.lit(x), c), F.substr(F.lit(x), n + 1, F.lit(1))) for x in classes), c)
        tweak = F.concat_ws(":", F.lit(kind), F.size(cs).cast("string"))
        return F.array_join(F.zip_with(cs, permute(F.transform(cs, value), F.transform(cs, size), tweak, key, back), spell), "")

    return let(chars(text), run)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def fill(form: Column, new: Column) -> Column:
    """The form with its digits replaced in order by the new ones."""
    put = lambda s, c: F.when(
        c.rlike("[0-9]"),
        F.struct(F.concat(s["done"], F.substr(s["left"], F.lit(1), F.lit(1))).alias("done"), F.substr(s["left"], F.lit(2)).alias("left"))
    ).otherwise(F.struct(F.concat(s["done"], c).alias("done"), s["left"].alias("left")))
    return F.aggregate(chars(form), F.struct(F.lit("").alias("done"), new.alias("left")), put, lambda s: s["done"])


def luhn_sum(number: Column) -> Column:
    """The check sum of a digit string, its last digit counting once."""
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(chars(F.reverse(number)), lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def iban_rest(iban: Column) -> Column:
    """The number that a compact IBAN stands for, modulo 97."""
    moved = chars(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.instr(F.lit(UPPER), c) + 9)
    return F.aggregate(moved, F.lit(0), lambda a, c: let(value(c), lambda v: F.when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97)))


def new_card(match: Column, key: str, back: bool) -> Column:
    def run(d: Column) -> Column:
        body = permute_text(F.substr(d, F.lit(1), F.length(d) - 1), "card", key, back)
        return let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    return fill(match, let(digits(match), run))


def new_iban(match: Column, key: str, back: bool) -> Column:
    def run(c: Column) -> Column:
        country, rest = F.substr(c, F.lit(1), F.lit(2)), permute_text(F.substr(c, F.lit(5)), "iban", key, back)
        return let(rest, lambda r: F.concat(country, F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), r))).cast("string"), 2, "0"), r))

    put = lambda s, c: F.when(
        c != " ",
        F.struct(F.concat(s["done"], F.substr(s["left"], F.lit(1), F.lit(1))).alias("done"), F.substr(s["left"], F.lit(2)).alias("left"))
    ).otherwise(F.struct(F.concat(s["done"], c).alias("done"), s["left"].alias("left")))
    return let(
        let(F.replace(match, F.lit(" "), F.lit("")), run),
        lambda new: F.aggregate(chars(match), F.struct(F.lit("").alias("done"), new.alias("left")), put, lambda s: s["done"])
    )


def numbers(values: list[Column], radices: list[int], kind: str, key: str, back: bool, spell) -> Column:
    """spell of the permuted values."""
    return let(permute(F.array(*(v.cast("int") for v in values)), F.array(*map(F.lit, radices)), F.lit(kind), key, back), spell)


def new_ip(match: Column, key: str, back: bool) -> Column:
    return numbers(
        [F.split_part(match, F.lit("."), F.lit(i)) for i in range(1, 5)], [256] * 4, "ip", key, back,
        lambda v: F.array_join(v.cast("array<string>"), ".")
    )


def new_ssn(match: Column, key: str, back: bool) -> Column:
    area = F.substr(match, F.lit(1), F.lit(3)).cast("int")
    values = [
        F.when(area > 666, area - 2).otherwise(area - 1), F.substr(match, F.lit(5), F.lit(2)).cast("int") - 1,
        F.substr(match, F.lit(8), F.lit(4)).cast("int") - 1
    ]
    pad = lambda n, width: F.lpad(n.cast("string"), width, "0")
    return numbers(
        values, [998, 99, 9999], "ssn", key, back,
        lambda v: F.concat_ws("-", pad(F.when(v[0] >= 665, v[0] + 2).otherwise(v[0] + 1), 3), pad(v[1] + 1, 2), pad(v[2] + 1, 4))
    )


#: Year, month and day of a date, and how to spell it.
DATES = (("^....-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), ("/", "MM/dd/yyyy"), (r"\.", "dd.MM.yyyy"))
FIRST_DAY, DAY_RADICES, LATE_RADICES = "1800-01-01", [189, 773], [9, 9833]  # days of 400 Gregorian years, and those after a month's twelfth


def parsed(match: Column) -> list[tuple[Column, str]]:
    """(date or null, format) in the order in which formats are tried."""
    return [(F.when(match.rlike(sign), F.try_to_date(match, form)), form) for sign, form in DATES]


def days_before(months: Column) -> Column:
    """How many of the days after a month's twelfth lie before the month that comes so many after the first."""
    return F.datediff(F.add_months(F.lit(FIRST_DAY).cast("date"), months), F.lit(FIRST_DAY).cast("date")) - 12 * months


def late_day_number(day: Column) -> Column:
    """The number of a day after its month's twelfth among all such days."""
    months = (F.year(day) - 1800) * 12 + F.month(day) - 1
    return days_before(months) + F.dayofmonth(day) - 13


def late_day(number: Column) -> Column:
    """The day of a late_day_number. A month has 88497 / 4800 of them on average, and no month's first strays from that by a whole month."""
    guess = F.floor(number * 4800 / 88497).cast("int")
    near = F.filter(F.array(*(F.greatest(F.lit(0), F.least(F.lit(4799), guess + i)) for i in (1, 0, -1))), lambda m: days_before(m) <= number)
    return let(F.get(near, F.lit(0)), lambda m: F.date_add(F.add_months(F.lit(FIRST_DAY).cast("date"), m), number - days_before(m) + 12))


def new_date(match: Column, key: str, back: bool) -> Column:
    def one(day: Column, form: str) -> Column:
        # of slash dates, those that are read by the second format are those whose day is no month
        alone = form == "MM/dd/yyyy"
        (first, second), kind = (LATE_RADICES, "late date") if alone else (DAY_RADICES, "date")
        n = late_day_number(day) if alone else F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        place = lambda v: v[0] * second + v[1]
        turn = lambda v: late_day(place(v)) if alone else F.date_add(F.lit(FIRST_DAY).cast("date"), place(v))
        return let(n, lambda x: numbers([(x / second).cast("int"), x % second], [first, second], kind, key, back, lambda v: F.date_format(turn(v), form)))

    out = F.lit(None).cast("string")
    for day, form in reversed(parsed(match)):
        out = F.when(day.isNotNull(), one(day, form)).otherwise(out)
    return out


def new_phone(match: Column, key: str, back: bool) -> Column:
    """The country code stays."""
    code = F.regexp_extract(match, r"^\+[0-9]{1,3}", 0)
    rest = F.substr(match, F.length(code) + 1)
    return F.concat(code, fill(rest, permute_text(digits(rest), "phone", key, back)))


def new_email(match: Column, key: str, back: bool) -> Column:
    """The domain stays."""
    name = F.substring_index(match, "@", 1)
    every = permute_text(name, "email", key, back, (LOWER, UPPER, DIGITS, *ALPHABETS))
    new = F.when(F.octet_length(name) == F.length(name), permute_text(name, "email", key, back)).otherwise(every)
    return F.concat(new, F.substr(match, F.length(name) + 1))


def valid(match: Column, kind: str) -> Column:
    whole = match.rlike(f"^(?:{PATTERNS[kind]})$")
    if kind == "ip":
        return whole & F.forall(F.split(match, r"\."), lambda x: x.cast("int") < 256)
    if kind == "card":
        return whole & match.rlike(r"^[0-9\x20-]*[0-9]$") & let(digits(match), lambda d: (F.length(d) <= 19) & (luhn_sum(d) % 10 == 0) & d.rlike("[1-9]"))
    if kind == "iban":
        return whole & let(F.replace(match, F.lit(" "), F.lit("")), lambda c: (F.length(c) <= 35) & (iban_rest(c) == 1))
    if kind == "ssn":
        return whole & match.rlike("^(?!000|666)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    if kind == "date":
        return whole & F.coalesce(
            F.coalesce(*(d for d, _ in parsed(match))).between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date")),
            F.lit(False)
        )
    return whole


def kind_of(match: Column) -> Column:
    """The first kind that the match validates as, or null."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(valid(match, kind), kind).otherwise(out)
    return out


def usual(match: Column, kind: Column) -> Column:
    """The match is written as its kind is: a card number in a known shape, an IBAN as long as its country's."""
    size, country = F.length(F.replace(match, F.lit(" "), F.lit(""))), F.substr(match, F.lit(1), F.lit(2))
    known = F.create_map(*(F.lit(x) for n, names in IBAN_LENGTHS.items() for name in names.split() for x in (name, n)))
    return F.when(kind == "card", match.rlike(CARD_SHAPES)).when(
        kind == "iban", F.coalesce(F.element_at(known, country) == size, F.lit(True))
    ).otherwise(kind.isNotNull())


#: Words and characters that a number in one of the usual shapes has at most: an IBAN in groups of four.
MOST_WORDS, LEAST_CHARS, MOST_CHARS = 10, 10, 45


def split_match(match: Column) -> Column:
    """kind, match of the parts of a run of numbers, in order: what validates between its separators, from the left and longest first, and the rest.

    Each word is looked at once, for what starts there; then what was found is taken from left to right.
    """
    none = F.lit(None).cast("string")
    gap = lambda words, low, high: F.struct(none.alias("kind"), F.array_join(F.slice(words, low + 1, F.greatest(high - low, F.lit(0))), "").alias("match"))

    def at(words: Column, i: Column) -> Column:
        """i, n (words), kind, lead (the separator before) and match of what starts with word i, or null."""
        lead = F.regexp_extract(F.get(words, i), r"^[\x20-]?", 0)
        text = lambda n: F.regexp_replace(F.array_join(F.slice(words, i + 1, n), ""), r"^[\x20-]", "")
        spans = F.transform(F.sequence(F.least(F.lit(MOST_WORDS), F.size(words) - i), F.lit(1), F.lit(-1)), lambda n: F.struct(n.alias("n"), text(n).alias("match")))
        spans = F.filter(spans, lambda x: F.length(x["match"]).between(LEAST_CHARS, MOST_CHARS))
        spans = F.transform(spans, lambda x: F.struct(x["n"].alias("n"), kind_of(x["match"]).alias("kind"), x["match"].alias("match")))
        first = F.get(F.filter(spans, lambda x: usual(x["match"], x["kind"])), F.lit(0))
        found = let(first, lambda x: F.when(x["n"].isNotNull(), F.struct(i.alias("i"), x["n"].alias("n"), x["kind"].alias("kind"), lead.alias("lead"), x["match"].alias("match"))))
        return F.when(F.get(words, i).rlike(r"^[\x20-]?[A-Z0-9]{3}"), found)  # no usual shape starts with fewer

    def run(words: Column) -> Column:
        candidates = F.filter(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: at(words, i)), lambda x: x.isNotNull())
        last = F.struct(F.lit(0).alias("end"), F.filter(F.slice(candidates, F.lit(1), F.lit(1)), lambda x: F.lit(False)).alias("out"))
        step = lambda s, x: F.when(x["i"] < s["end"], s).otherwise(F.struct((x["i"] + x["n"]).alias("end"), F.concat(s["out"], F.array(x)).alias("out")))
        chosen = F.aggregate(candidates, last, step, lambda s: s["out"])

        def spelled(xs: Column) -> Column:
            end = lambda j: F.coalesce(F.get(xs, j - 1)["i"] + F.get(xs, j - 1)["n"], F.lit(0))
            part = lambda x, j: F.array(
                gap(words, end(j), x["i"]), F.struct(none.alias("kind"), x["lead"].alias("match")), F.struct(x["kind"].alias("kind"), x["match"].alias("match"))
            )
            return F.concat(F.flatten(F.transform(xs, part)), F.array(gap(words, end(F.size(xs)), F.size(words))))

        return let(chosen, spelled)

    return let(F.regexp_extract_all(match, F.lit(r"[\x20-]?[^\x20-]+|[\x20-]"), F.lit(0)), run)


def parts_of(match: Column) -> Column:
    """kind, match of the parts that make up a match: one where it validates as a whole."""

    def choose(x: Column) -> Column:
        whole = F.array(F.struct(x["kind"].alias("kind"), x["match"].alias("match")))
        parts = let(split_match(x["match"]), lambda p: F.when(F.exists(p, lambda y: y["kind"].isNotNull()), p).otherwise(whole))
        return F.when(usual(x["match"], x["kind"]) | ~x["match"].rlike(r"^[A-Z0-9]+[\x20-]"), whole).otherwise(parts)

    return let(F.struct(kind_of(match).alias("kind"), match.alias("match")), choose)


def pseudonym(match: Column, kind: Column, key: str, back: bool = False) -> Column:
    make = {"email": new_email, "iban": new_iban, "phone": new_phone, "ssn": new_ssn, "date": new_date, "ip": new_ip, "card": new_card}
    out = match
    for name, new in make.items():
        out = F.when(kind == name, new(match, key, back)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", back: bool = False, into: str = "pii") -> DataFrame:
    """docs with text rewritten, and a new column (named by into) of the matches: kind, match, pseudonym. back turns pseudonyms back."""
    into = fresh(docs, into)
    old, own = F.col(text), fresh(docs.withColumn(into, F.lit(0)), "pii_found")
    found = F.when(old.rlike(HINT), F.regexp_extract_all(old, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(own, parts_of)
    named = F.transform(
        own,
        lambda m: F.transform(
            m,
            lambda x: F.struct(
                x["kind"].alias("kind"), x["match"].alias("match"),
                F.coalesce(pseudonym(x["match"], x["kind"], key, back), x["match"]).alias("pseudonym")
            )
        )
    )
    rows = docs.withColumn(own, found).withColumn(own, kinds).withColumn(own, named)
    gaps = F.split(old, ANY, -1)
    pieces = F.zip_with(
        gaps, F.concat(F.transform(own, lambda m: F.array_join(F.transform(m, lambda x: x["pseudonym"]), "")), F.array(F.lit(""))),
        lambda g, p: F.concat(g, p)
    )
    new = F.when(F.size(own) > 0, F.array_join(pieces, "")).otherwise(old)
    return rows.withColumn(text, new).withColumn(into, F.filter(F.flatten(own), lambda x: x["kind"].isNotNull())).drop(own)


def op7(docs: DataFrame) -> DataFrame:
    rows = pseudonymise(docs.select("doc_id", "text"), DEMO_KEY)
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", "text", F.coalesce(F.size("pii"), F.lit(0)).cast("long").alias("n_pii"), *map(count, KINDS),
        F.array_join(F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["pseudonym"])), "\n").alias("pseudonyms")
    )
