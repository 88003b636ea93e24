import datetime
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import pii


def luhn(number):
    values = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(values)) % 10


def feistel(symbols, radices, tweak, key, back=False):
    half = len(symbols) // 2
    parts, radix = [symbols[:half], symbols[half:]], [radices[:half], radices[half:]]
    for k in range(pii.ROUNDS)[:: -1 if back else 1]:
        own, other = k % 2, 1 - k % 2
        h = hashlib.sha256("|".join([key, tweak, str(k), ",".join(map(str, parts[other]))]).encode()).hexdigest()
        out = []
        for i, (x, r) in enumerate(zip(parts[own], radix[own], strict=True)):
            s = h if i < 16 else hashlib.sha256(f"{h}|{i // 16}".encode()).hexdigest()
            step = int(s[4 * (i % 16) : 4 * (i % 16) + 4], 16)
            out.append((x - step if back else x + step) % r)
        parts[own] = out
    return parts[0] + parts[1]


KEY = "a key of the tests"


TEXT = """Mail anna.B-7@mail3.example.com, or +1 (084) 555-3661; card 4111 1111 1111 1111 and 4111-1111-1111-1111
and 4111111111111111 but not 4111111111111112, ip 170.106.47.218 not 300.1.1.1, born 1984-02-29 or 29/02/1984, 12/31/1999, 31.12.1999,
not 1983-02-29; ssn 123-45-6789 not 000-45-6789, iban GB82 WEST 1234 5698 7654 32 or DE89370400440532013000, not DE88370400440532013000.
v1.2.3 2024 x 1234567 é +44 20 7946 0958 (212) 555-0100"""
ROWS = [
    (1, TEXT), (2, "x 4111 1111 1111 1111 y anna.B-7@mail3.example.com"), (3, None), (4, ""), (5, "nothing 12 here"),
    (6, "170.106.47.218 " * 5000), (1, TEXT), (7, "a@b.c 0000000000000000 +1 (843) 555-7672 170.106.47.218 Et")
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, pii_kind int")
    return pii.pseudonymise(df, KEY).cache()


def test_what_is_found(found):
    rows = {r.doc_id: r for r in found.collect()}
    kinds = Counter(x.kind for x in rows[1].pii)
    assert kinds == {"email": 1, "phone": 3, "card": 3, "ip": 1, "date": 4, "ssn": 1, "iban": 2}
    assert [x.match for x in rows[7].pii] == ["a@b.c", "+1 (843) 555-7672", "170.106.47.218"]
    assert rows[3].text is None and rows[4].text == "" and rows[5].text == "nothing 12 here" and len(rows[6].pii) == 5000
    for kept in ("4111111111111112", "300.1.1.1", "1983-02-29", "000-45-6789", "DE88370400440532013000", "v1.2.3 2024 x 1234567 é"):
        assert kept in rows[1].text
    assert len(rows[6].text.split()) == 5000 and len(set(rows[6].text.split())) == 1


def test_formats_and_links(found):
    rows = {r.doc_id: r for r in found.collect()}
    new = [(x.kind, x.match, x.pseudonym) for x in rows[1].pii]
    for kind, match, out in new:
        assert out != match and re.fullmatch(pii.PATTERNS[kind], out) and match not in rows[1].text
        if kind not in ("ip",):
            assert re.sub(r"[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", out))) == re.sub(
                r"[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", match))
            )
        if kind == "card":
            assert luhn(re.sub(r"\D", "", out)) == 0
        if kind == "iban":
            compact = out.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1
        if kind == "ip":
            assert all(int(x) < 256 for x in out.split("."))
    assert len({re.sub(r"\D", "", out) for kind, _, out in new if kind == "card"}) == 1
    dates = [out for kind, _, out in new if kind == "date"]
    assert datetime.date.fromisoformat(dates[0]) == datetime.datetime.strptime(dates[1], "%d/%m/%Y").date()
    assert datetime.datetime.strptime(dates[2], "%m/%d/%Y").day > 12
    by = {(x.kind, x.match): x.pseudonym for x in rows[1].pii}
    assert all(by[x.kind, x.match] == x.pseudonym for x in rows[2].pii)


def test_against_python(found):
    rows = {r.doc_id: r for r in found.collect()}
    by = {x.match: x.pseudonym for x in rows[1].pii}
    assert by["170.106.47.218"] == ".".join(map(str, feistel([170, 106, 47, 218], [256] * 4, "ip", KEY)))
    body = "".join(map(str, feistel([4] + [1] * 14, [10] * 15, "card:15", KEY)))
    assert by["4111111111111111"][:15] == body
    name = "anna.B-7"
    classes = [next((c for c in (pii.LOWER, pii.UPPER, pii.DIGITS) if x in c), x) for x in name]
    out = feistel([c.index(x) for c, x in zip(classes, name)], [len(c) for c in classes], "email:8", KEY)
    assert by["anna.B-7@mail3.example.com"] == "".join(c[i] for c, i in zip(classes, out)) + "@mail3.example.com"


def test_round_trip(spark, found):
    back = pii.pseudonymise(found.drop("pii"), KEY, back=True)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(ROWS)
    other = {r.doc_id: r.text for r in pii.pseudonymise(found.drop("pii"), "another key", back=True).collect()}
    assert other[1] != TEXT


@pytest.mark.parametrize("form", ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy"])
def test_all_days_come_back(spark, form):
    """Of 1800 to 2199; slash dates whose day could be a month are read as day/month and permuted among all days."""
    days = spark.range(146_097).select(F.col("id").alias("doc_id"), F.date_format(F.expr("date_add(date'1800-01-01', cast(id as int))"), form).alias("text"))
    if form == "MM/dd/yyyy":
        days = days.where("cast(substr(text, 4, 2) as int) > 12")
    new = pii.pseudonymise(days, KEY).cache()
    n, kinds, same = new.agg(F.count("*"), F.countDistinct("text"), F.count_if(F.size("pii") == 1)).first()
    assert n == kinds == same == (88_497 if form == "MM/dd/yyyy" else 146_097)
    again = pii.pseudonymise(new.drop("pii"), KEY, back=True)
    assert again.join(days.withColumnRenamed("text", "old"), "doc_id").where("text <> old").isEmpty()


def test_all_areas_come_back(spark):
    ssns = spark.range(1, 1000).where("id <> 666").select(
        F.col("id").alias("doc_id"), F.format_string("%03d-%02d-%04d", "id", F.col("id") % 99 + 1, F.col("id") * 9 + 1).alias("text")
    )
    new = pii.pseudonymise(ssns, KEY).cache()
    assert new.select("text").distinct().count() == 998 == new.where(F.size("pii") == 1).count()
    assert pii.pseudonymise(new.drop("pii"), KEY, back=True).join(ssns.withColumnRenamed("text", "old"), "doc_id").where("text <> old").isEmpty()


def new_text(text, kind, key):
    classes = [next((c for c in (pii.LOWER, pii.UPPER, pii.DIGITS, *pii.ALPHABETS) if x in c), x) for x in text]
    out = feistel([c.index(x) for c, x in zip(classes, text, strict=True)], [len(c) for c in classes], f"{kind}:{len(text)}", key)
    return "".join(c[i] for c, i in zip(classes, out, strict=True))


def filled(form, new, what=str.isdigit):
    left = iter(new)
    return "".join(next(left) if what(c) else c for c in form)


def read_date(text):
    for sign, form in (("-", "%Y-%m-%d"), ("/", "%d/%m/%Y"), ("/", "%m/%d/%Y"), (".", "%d.%m.%Y")):
        if sign in text:
            try:
                day = datetime.datetime.strptime(text, form).date()
                return (day, form) if 1800 <= day.year < 2200 else None
            except ValueError:
                pass
    return None


def rest_97(compact):
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def slow_pseudonym(m, key, late):
    """What becomes of a whole match, or None."""
    whole = lambda kind: re.fullmatch(pii.PATTERNS[kind], m, re.ASCII)
    digits = re.sub("[^0-9]", "", m)
    if whole("email"):
        name, domain = m.split("@", 1)
        return new_text(name, "email", key) + "@" + domain
    if whole("iban") and rest_97(m.replace(" ", "")) == 1 and len(m.replace(" ", "")) <= 35:
        c = m.replace(" ", "")
        rest = new_text(c[4:], "iban", key)
        return filled(m, c[:2] + f"{98 - rest_97(c[:2] + '00' + rest):02d}" + rest, lambda x: x != " ")
    if whole("phone"):
        code = (re.match(r"\+[0-9]{1,3}", m) or [""])[0]
        return code + filled(m[len(code) :], new_text(re.sub("[^0-9]", "", m[len(code) :]), "phone", key))
    if whole("ssn") and re.fullmatch(r"(?!000|666)\d{3}-(?!00)\d\d-(?!0000)\d{4}", m):
        a, b, c = map(int, m.split("-"))
        a, b, c = feistel([a - 2 if a > 666 else a - 1, b - 1, c - 1], [998, 99, 9999], "ssn", key)
        return f"{a + 2 if a >= 665 else a + 1:03d}-{b + 1:02d}-{c + 1:04d}"
    if whole("date") and read_date(m):
        day, form = read_date(m)
        if form == "%m/%d/%Y":
            a, b = feistel(list(divmod(late.index(day), 9833)), [9, 9833], "late date", key)
            return late[a * 9833 + b].strftime(form)
        start = datetime.date(1800, 1, 1)
        a, b = feistel(list(divmod((day - start).days, 773)), [189, 773], "date", key)
        return (start + datetime.timedelta(a * 773 + b)).strftime(form)
    if whole("ip") and all(int(x) < 256 for x in m.split(".")):
        return ".".join(map(str, feistel(list(map(int, m.split("."))), [256] * 4, "ip", key)))
    if whole("card") and m[-1].isdigit() and not set(m) - set("0123456789 -") and len(digits) <= 19 and luhn(digits) == 0 and digits.strip("0"):
        body = new_text(digits[:-1], "card", key)
        return filled(m, body + str(-luhn(body + "0") % 10))
    return None


def test_whole_texts_against_python(spark):
    rng = random.Random(8)
    start = datetime.date(1800, 1, 1)
    late = [d for d in (start + datetime.timedelta(i) for i in range(146_097)) if d.day > 12]
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = number(15)
        whole = body + str(-luhn(body + "0") % 10)
        return rng.choice([whole, " ".join(whole[i : i + 4] for i in range(0, 16, 4)), whole[:-1] + str((int(whole[-1]) + 1) % 10)])

    def iban():
        rest = number(18)
        good = f"DE{98 - rest_97('DE00' + rest):02d}{rest}"
        return rng.choice([good, " ".join(good[i : i + 4] for i in range(0, 22, 4)), "DE00" + rest])

    date = lambda: rng.choice(
        [
            f"{rng.randint(1790, 2205)}-{rng.randint(0, 13):02d}-{rng.randint(0, 32):02d}",
            f"{rng.randint(1, 31):02d}/{rng.randint(1, 31):02d}/{rng.randint(1800, 2199)}",
            f"{rng.randint(1, 31):02d}.{rng.randint(1, 12):02d}.{rng.randint(1800, 2199)}"
        ]
    )
    make = [
        card, iban, date, lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: ".".join(str(rng.randint(0, 290)) for _ in range(4)), lambda: f"+44 20 {number(4)} {number(4)}", lambda: f"({number(3)}) {number(3)}-{number(4)}",
        lambda: "".join(rng.choice("abZ9._") for _ in range(rng.randint(1, 9))) + "@mail." + rng.choice(["com", "co.uk", "x-y.org"]), lambda: "plain wörd, not 1.2.3 or a_b", lambda: "\n",
    ]
    texts = ["; ".join(rng.choice(make)() for _ in range(rng.randint(1, 40))) for _ in range(120)]
    any_ = re.compile(pii.ANY, re.ASCII)
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()}
    for i, text in enumerate(texts):
        assert got[i] == any_.sub(lambda m: slow_pseudonym(m[0], KEY, late) or m[0], text)


def test_long_texts_end(spark):
    """Long domains, digit runs and near-matches stop neither the matcher nor the JVM."""
    texts = [
        "a@b" + ".c" * 200_000, "1" * 500_000, "1 " * 300_000, "AB12 " * 100_000, "+1 " * 200_000, "1." * 300_000, "a" * 400_000 + "@",
        "@" * 300_000, "x" * 300_000 + " 170.106.47.218"
    ]
    rows = pii.pseudonymise(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY
    ).select("doc_id", F.length("text").alias("n"), F.size("pii").alias("found")).collect()
    assert {r.doc_id: r.n for r in rows if r.doc_id != 8} == {i: len(t) for i, t in enumerate(texts) if i != 8} and {r.doc_id: r.found for r in rows}[8] == 1


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a@b.cc", 7, 8)], "doc_id long, text string, pii int, PII_ int")
    row = pii.pseudonymise(df, KEY).first()
    assert row.pii == 7 and row.PII_ == 8 and len(row.pii__) == 1


@pytest.mark.parametrize("radices", [[10], [10, 10], [26, 10, 1], [7, 11, 2]])
def test_it_is_a_permutation(spark, radices):
    import itertools

    rows = [(list(x),) for x in itertools.product(*map(range, radices))]
    r = F.array(*map(F.lit, radices))
    df = spark.createDataFrame(rows, "v array<int>").select("v", pii.permute(F.col("v"), r, F.lit("t"), "k").alias("p"))
    got = df.select("v", "p", pii.permute(F.col("p"), r, F.lit("t"), "k", back=True).alias("b")).collect()
    assert len({tuple(x.p) for x in got}) == len(rows) and all(x.b == x.v for x in got)
    assert all(x.p == feistel(x.v, radices, "t", "k") for x in got)


def test_native_and_empty(none):
    df = pii.op7(none)
    assert df.count() == 0
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


NEIGHBOURS = [
    ("4111 1111 1111 1111 123", ["4111 1111 1111 1111"]),
    ("4111111111111111 12/26", ["4111111111111111"]),
    ("order 12 4111 1111 1111 1111.", ["4111 1111 1111 1111"]),
    ("12 34 4111 1111 1111 1111 123 99", ["4111 1111 1111 1111"]),
    ("4111111111111111 2024-01-05", ["4111111111111111", "2024-01-05"]),
    ("BE68 5390 0754 7034 EUR", ["BE68 5390 0754 7034"]),
    ("BE68 5390 0754 7034 4111 1111 1111 1111", ["BE68 5390 0754 7034", "4111 1111 1111 1111"]),
    ("at 2024-01-05T10:00:00Z", ["2024-01-05"]),
    ("4111 1111 1111 1112 123", []),
]


def test_numbers_beside_others(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in NEIGHBOURS)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(df, KEY).collect()}
    for i, (text, want) in enumerate(NEIGHBOURS):
        assert [x.match for x in rows[i].pii] == want, text
        for x in rows[i].pii:
            text = text.replace(x.match, x.pseudonym)
        assert rows[i].text == text and not any(x in rows[i].text for x in want)


def test_a_card_anywhere_in_a_run(spark):
    """Wherever it stands among other numbers, and however many there are."""
    card = "4111 1111 1111 1111"
    texts = [" ".join(["7"] * n + [card] + ["7"] * after) for n in [*range(131), 5000] for after in (0, 3)] + [f"{card}{end}" for end in ("", " ", "-", ".", ", x", " - 5")]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()
    for r in rows:
        assert [x.match for x in r.pii] == [card] and card not in r.text and len(r.text) == len(texts[r.doc_id]), texts[r.doc_id]
        assert r.text == texts[r.doc_id].replace(card, r.pii[0].pseudonym)
    kept = [f"{card}abc", f"{card}.50", f"{card}_", "4111 1111 1111 1112", "x4111111111111111"]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(kept)), "doc_id long, text string"), KEY).collect()
    assert all(r.text == kept[r.doc_id] for r in rows)


def test_addresses_of_any_length_and_script(spark):
    names = ["a" * 70, "x." * 3000 + "y", "jörg", "İlker", "иван.петров", "Ωμέγα", "žofie", "名前"]
    texts = [f"write to {n}@example.com now" for n in names] + ["call +49 30 1234567 today"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = pii.pseudonymise(docs, KEY).cache()
    for r in new.collect():
        assert len(r.pii) == 1 and len(r.text) == len(texts[r.doc_id])
        if r.doc_id < len(names) - 1:
            old, now = names[r.doc_id], r.pii[0].pseudonym.split("@")[0]
            assert r.pii[0].match == f"{old}@example.com" and now != old and len(now) == len(old)
    assert [r.text for r in pii.pseudonymise(new.drop("pii"), KEY, back=True).orderBy("doc_id").collect()] == texts
    same = sum(a == b for r in new.where("doc_id = 4").collect() for a, b in zip(names[4], r.pii[0].pseudonym, strict=False))
    assert same <= 4
