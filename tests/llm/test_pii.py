import datetime
import hashlib
import random
import re
import time

import pytest
import regex
from pyspark.sql import functions as F

from netsift.llm import pii
from netsift.llm.pii import DAYS, feistel_number, feistel_text
from tests.llm.fixtures import docs


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(digits))) % 10 == 0


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


VALID = ["4041894974608795", "4041 8949 7460 8795", "5500-0000-0000-0004", "+1 (988) 555-2485", "(212) 555-0199", "555-123-4567", "bosbt.42@mail8.example.com", "Foo.Bar@X.org", "70.123.182.155", "1980-02-29", "29.2.1980", "02/29/1980", "1999/12/31", "123-45-6789", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
INVALID = ["4041894974608796", "300.1.2.3", "1981-02-29", "000-12-3456", "666-12-3456", "DE88 3704 0044 0532 0130 00", "1234567", "4.0.", "v2.0 and 3.5", "deadbeef40418949746087951234abcd", "a@b", "@home", "2024-13-01"]


def pseudonymise(df, key="netsift", **more):
    return pii.pseudonymise(df, key, **more)


def changed(spark, texts, **more):
    return [r["text"] for r in pseudonymise(docs(spark, [(k, t, "s") for k, t in enumerate(texts)]), **more).orderBy("doc_id").collect()]


def test_formats_stay_valid(spark):
    got = changed(spark, VALID)
    for old, new in zip(VALID, got):
        assert new != old and re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", old))) or "." in old or "/" in old
    assert all(luhn(re.sub(r"\D", "", got[k])) for k in range(3)) and re.sub(r"\D", "", got[0]) == re.sub(r"\D", "", got[1])
    assert all(int(x) < 256 for x in got[8].split("."))
    day = datetime.date.fromisoformat(got[9])
    assert [int(x) for x in got[10].split(".")] == [day.day, day.month, day.year]
    assert got[11] == f"{day.month:02}/{day.day:02}/{day.year}"
    assert all(mod97(re.sub(" ", "", got[k])) == 1 for k in (14, 15))
    assert changed(spark, VALID, key="other") != got


def test_invalid_values_and_other_text_stay(spark):
    assert changed(spark, INVALID) == INVALID
    texts = [None, "", "no data at all", "é" * 5000, "é 4041894974608795, é"]
    got = changed(spark, texts)
    assert got[:4] == texts[:4] and got[4][:2] == "é " and got[4][18:] == ", é"


def test_counts_links_and_inversion(spark):
    rows = [(1, " ".join(VALID) + " x " + VALID[0], "s"), (2, "again " + VALID[0], "s"), (2, "again " + VALID[0], "s"), (None, VALID[6], None)]
    df = docs(spark, rows)
    out = pseudonymise(df, count_col="n_replaced")
    assert out.columns == [*df.columns, "n_replaced"]
    got = out.collect()
    assert [r["n_replaced"] for r in got] == [17, 1, 1, 1]
    new = got[1]["text"].split()[1]
    assert got[0]["text"].startswith(new) and got[0]["text"].endswith(new)
    back = pseudonymise(out.drop("n_replaced"), invert=True).collect()
    assert [r["text"] for r in back] == [t for _, t, _ in rows]
    assert pseudonymise(docs(spark, []), count_col="n_replaced").collect() == []


@pytest.mark.parametrize("a,b", [(7, 11), (1, 5), (16, 16)])
def test_feistel_number_is_a_bijection(spark, a, b):
    df = spark.range(a * b).select("id", feistel_number(F.col("id"), a, b, "k", F.lit("t")).alias("p"))
    got = df.withColumn("back", feistel_number(F.col("p"), a, b, "k", F.lit("t"), invert=True)).collect()
    assert sorted(r["p"] for r in got) == list(range(a * b)) and all(r["id"] == r["back"] for r in got)


def test_feistel_text_is_a_bijection(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    got = df.select("v", feistel_text(F.col("v"), "0123456789", "k", F.lit("t")).alias("p")).collect()
    assert len({r["p"] for r in got}) == 1000 and all(len(r["p"]) == 3 for r in got)


def test_dates_come_back(spark):
    days = [datetime.date(1980, 1, 1) + datetime.timedelta(k) for k in range(366)]
    texts = [f"{d.day}.{d.month}.{d.year}" for d in days] + [f"{d.day:02}.{d.month:02}.{d.year}" for d in days]
    back = changed(spark, changed(spark, texts), invert=True)
    assert [[int(x) for x in t.split(".")] for t in back] == [[d.day, d.month, d.year] for d in days] * 2 and back[366:] == texts[366:]


def test_days_cover_400_years():
    assert DAYS[0] * DAYS[1] == (datetime.date(2200, 1, 1) - datetime.date(1800, 1, 1)).days


def test_values_beside_others(spark):
    phone, card, ip = "+1 (826) 555-4081", "4111 1111 1111 1111", "190.137.223.204"
    alone = dict(zip((phone, card, ip, "+44 20 7946 0958", "+18265554081"), changed(spark, [phone, card, ip, "+44 20 7946 0958", "+18265554081"])))
    beside = [
        (phone, " ", ip), (phone, " 12 people", ""), (phone, " 4711", ""), ("+44 20 7946 0958", " ", ip), ("+44 20 7946 0958", " ", card), (phone, " ", card), ("+18265554081", " 190", ""),
        (card, " 12/25", ""), (card, " 123", ""), (card, " 1234", ""), (card, " ", ip), ("", "in 2024 ", card), ("", "12 ", card), (card, " ", card), (card, " ", phone), (ip, " ", card),
    ]
    texts = ["".join(b) for b in beside]
    got = changed(spark, texts)
    assert got == [alone.get(a, a) + between + alone.get(b, b) for a, between, b in beside]
    assert all(k != v for k, v in alone.items())
    assert changed(spark, got, invert=True) == texts
    odd = ["+49 30 12345-67", "+33 1-23 45-67 89", "+49 30 123-45-67", "+4930123 4567", "40418 94974 60879 5"]
    assert all(re.sub("[0-9]", "9", a) == re.sub("[0-9]", "9", b) and a[-2:] != b[-2:] or a.startswith("4") and a != b for a, b in zip(odd, changed(spark, odd)))


def test_country_codes_and_times(spark):
    got = changed(spark, ["+15551234567", "+1 5551234567", "+442079460958", "+35312345678", "at 2020-01-05T10:00:00Z", "2020-01-05"])
    assert got[0][:2] == "+1" and got[0][2:] == got[1][3:] and got[2][:3] == "+44" and got[3][:4] == "+353"
    assert got[4] == f"at {got[5]}T10:00:00Z" and got[5] != "2020-01-05"


def test_key_is_no_constant(spark):
    assert pii.secret(spark) == pii.secret(spark) and len(pii.secret(spark)) == 64
    spark.conf.set(pii.KEY, "of the session")
    try:
        assert pii.secret(spark) == "of the session"
    finally:
        spark.conf.unset(pii.KEY)


def test_clashing_columns_stay(spark):
    df = docs(spark, [(1, "mail a.b@c.org", "s")]).selectExpr("doc_id", "text", "1 as __found", "2 as __NEW", "3 as found")
    out = pseudonymise(df)
    assert out.columns == df.columns and tuple(out.head())[2:] == (1, 2, 3)


N = 1_000_000


@pytest.mark.parametrize("text", [
    "x@" + "a." * (N // 2) + "com", "a" * N + "@b.com", "a@" * (N // 2), "x@" + "a" * N + ".com", "a.b@c.d " * (N // 8),
    "AB12 " * (N // 5), "AB12" * (N // 4), "1." * (N // 2), "255." * (N // 4), "1-" * (N // 2), "2020-01-" * (N // 8), "1/" * (N // 2),
    "1 " * (N // 2), "1" * N, "12 " * (N // 3), "1234 " * (N // 5), "1234567890123 " * (N // 14), "+1 " * (N // 3), "+" * N, "(1" * (N // 2), "+1 (555) " * (N // 9), "555-123-" * (N // 8), "+1 555 1234 " * (N // 120) + "+1 555 " * (N // 8),
])
def test_hostile_texts_of_a_million_characters(spark, text):
    began = time.time()
    got = changed(spark, [text])
    assert len(got[0]) == len(text) and time.time() - began < 60


def test_long_values_at_the_bounds(spark):
    assert changed(spark, ["a" * 65 + "@b.com"]) == ["a" * 65 + "@b.com"]
    mail = "b" * 64 + "@" + "a." * 126 + "com"
    assert changed(spark, [mail])[0] != mail and changed(spark, ["@".join(("c", "a." * 127 + "com"))]) == ["@".join(("c", "a." * 127 + "com"))]


class Plain:
    """The same pseudonyms by plain Python, value by value."""

    def __init__(self, key):
        self.key = key

    def prf(self, tweak, turn, value):
        return hashlib.sha256(f"{self.key}|{tweak}|{turn}|{value}".encode()).hexdigest()

    def text(self, value, alphabet, tweak):
        half = -(-len(value) // 2)
        side = [value[:half], value[half:]]
        for turn in range(1, 9):
            own, other = (0, 1) if turn % 2 else (1, 0)
            digest = bytes.fromhex(self.prf(tweak, turn, side[other]))
            side[own] = "".join(alphabet[(alphabet.index(c) + digest[j % 32]) % len(alphabet)] for j, c in enumerate(side[own]))
        return "".join(side)

    def number(self, value, a, b, tweak):
        side, sizes = list(divmod(value, b)), (a, b)
        for turn in range(1, 9):
            own, other = (0, 1) if turn % 2 else (1, 0)
            side[own] = (side[own] + int(self.prf(tweak, turn, side[other])[:15], 16)) % sizes[own]
        return side[0] * b + side[1]

    def refill(self, match, chars, new):
        new = iter(new)
        return "".join(next(new) if c in chars else c for c in match)

    def digits(self, match, tweak, letters="0123456789"):
        return self.refill(match, letters, self.text("".join(c for c in match if c in letters), letters, tweak))

    def email(self, m):
        local, rest = m.split("@", 1)
        new = self.digits(self.digits(local.lower(), "mail a", "abcdefghijklmnopqrstuvwxyz"), "mail 0")
        return "".join(n.upper() if c.isupper() else n for n, c in zip(new, local)) + "@" + rest

    def iban(self, m):
        bare = m.replace(" ", "")
        if mod97(bare) != 1:
            return m
        body = self.digits(bare[4:], "iban " + bare[:2])
        return self.refill(m, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", f"{bare[:2]}{98 - mod97(bare[:2] + '00' + body):02}{body}")

    def ip(self, m):
        parts = [int(x) for x in m.split(".")]
        if max(parts) > 255:
            return m
        return ".".join(map(str, self.number(int.from_bytes(bytes(parts), "big"), 1 << 16, 1 << 16, "ip").to_bytes(4, "big")))

    def date(self, m):
        sep = "-" if "-" in m else "/" if "/" in m else "."
        one, two, three = m.split(sep)
        if len(one) == 4:
            order = "ymd"
        elif sep == "/" and 1 <= int(two) <= 31 and int(one) <= 12:
            order = "mdy"
        else:
            order = "dmy"
        of = dict(zip(order, (one, two, three)))
        try:
            at = (datetime.date(int(of["y"]), int(of["m"]), int(of["d"])) - datetime.date(1800, 1, 1)).days
        except ValueError:
            return m
        if not 0 <= at < 146097:
            return m
        width = 2 if order == "ymd" or len(one) == len(two) == 2 else 1
        new = datetime.date(1800, 1, 1) + datetime.timedelta(self.number(at, 189, 773, "date"))
        return sep.join({"y": str(new.year), "m": f"{new.month:0{width}}", "d": f"{new.day:0{width}}"}[k] for k in order)

    def ssn(self, m):
        area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return m
        new = self.number(((area - (2 if area > 666 else 1)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
        high, low = divmod(new, 9999)
        a = high // 99 + 1
        return f"{a + (a >= 666):03}-{high % 99 + 1:02}-{low + 1:04}"

    def phone(self, m):
        if not 7 <= sum(c.isdigit() for c in m) <= 15:
            return m
        land = regex.match(rf"(\+[0-9]{{1,3}}(?=[ .(-])|{pii._COUNTRY})?", m)[0]
        return land + self.digits(m[len(land) :], "phone")

    def card(self, m):
        d = re.sub("[^0-9]", "", m)
        fours = re.fullmatch("[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,4}", m)
        lo, hi = 0, len(m)
        if fours and luhn(d[:16]):
            hi = 19
        elif fours and len(m) == 24:
            lo, hi = (5, 24) if luhn(d[4:]) else (0, 19)
        part = re.sub("[^0-9]", "", m[lo:hi])
        if not luhn(part):
            return m
        new = part[0] + self.text(part[1:-1], "0123456789", "card " + part[0])
        new += next(c for c in "0123456789" if luhn(new + c))
        return m[:lo] + self.refill(m[lo:hi], "0123456789", new) + m[hi:]

    def whole(self, text):
        return regex.sub(pii.ANY, lambda m: self.one(m[0]), text)

    def one(self, m):
        if "@" in m:
            return self.email(m)
        return next((getattr(self, k)(m) for k in ("iban", "ip", "date", "ssn", "phone") if regex.fullmatch(pii.FORMATS[k], m)), None) or self.card(m)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_equal_plain_python(spark, seed):
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kinds = [
        lambda: rng.choice(VALID), lambda: rng.choice(INVALID), lambda: number(rng.randint(1, 20)), lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: ".".join(str(rng.randint(0, 300)) for _ in range(4)),
        lambda: f"+{number(rng.randint(1, 3))} {number(rng.randint(2, 4))} {number(rng.randint(2, 4))} {number(rng.randint(2, 4))}", lambda: f"{rng.randint(1700, 2300)}-{rng.randint(1, 13):02}-{rng.randint(1, 32):02}",
        lambda: f"{rng.randint(1, 32)}{(c := rng.choice('/.'))}{rng.randint(1, 13)}{c}{rng.randint(1700, 2300)}", lambda: "-".join(number(4) for _ in range(rng.randint(3, 6))), lambda: rng.choice(["word", "é", "a@", "+", "(", "."]),
        lambda: f"{rng.choice('aZ')}{number(2)}@{rng.choice(['b-c.de', 'x.y.zed', 'q'])}", lambda: "".join(rng.choice("AB01 -.@+/()") for _ in range(12)),
    ]
    texts = [rng.choice([" ", ", ", "; "]).join(rng.choice(kinds)() for _ in range(rng.randint(1, 12))) for _ in range(300)]
    plain = Plain("netsift")
    assert changed(spark, texts) == [plain.whole(t) for t in texts]
