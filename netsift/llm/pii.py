"""Format-preserving Feistel pseudonyms of personal data, in SQL functions only.

Numbers that pass their format's validation (payment cards by Luhn, account
numbers by mod 97, network addresses, social security and telephone numbers),
dates and mail addresses are permuted under a key within their own format.  A
Feistel network over the value's characters, or over a pair of mixed radices, is
a bijection of the format's values: equal values get equal pseudonyms in all
documents, different ones different ones, length and punctuation stay (but for numbers without leading
zeros, as in addresses and some dates), check digits stay right, and the key's owner can invert it.  A date is
one value however it is written; inverted, one without leading zeros may have them.
"""

from __future__ import annotations

import secrets
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm.common import table, unused

#: Feistel rounds, and the setting that holds the key.
ROUNDS, KEY = 8, "spark.netsift.pii.key"
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"

#: What a group after a space may not begin, as it is a value of its own: a date, an address, a time, 555-123-4567, a card.
_OTHER = r"(?! [0-9]+(?:[/:%]|[.-][0-9]+[.-][0-9])| [0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]| [0-9]{13})"
#: 7 to 15 digits from the plus on; a longer match gives groups back until it holds.
_DIGIT = "[ .()-]{0,2}[0-9]"
_LENGTH = rf"(?<=\+{_DIGIT * 7}{f'(?:{_DIGIT})?' * 8})(?![0-9])"
_AREA = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})"
#: Digits without a gap; the layout of +1; groups after spaces, then after others, so that no space joins a tail on; any groups.
_PHONE = (
    r"(?<![A-Za-z0-9+])(?:\+[0-9]{11,15}(?![0-9])"
    r"|\+1(?:[ .-]?\([0-9]{3}\)|[ .-][0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9]|[.-][0-9])"
    rf"|{_AREA}(?=(?:[ .-]?[0-9]{{2,4}}){{2}})(?:(?:{_OTHER} )?[0-9]{{2,4}}){{0,4}}(?:[.-]?[0-9]{{2,4}}){{0,3}}{_LENGTH}"
    rf"|{_AREA}(?:[ .-]?[0-9]{{2,4}}){{2,4}}{_LENGTH})"
)
#: Card numbers as they are printed: digits without a gap, 4-6-5 or 4-6-4, and fours, with a tail or a fifth four that _card tells apart.
_PRINTED = r"(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:%s[ -][0-9]{1,3}|[ -][0-9]{4}(?![ -][0-9]{4}))?)(?![A-Za-z0-9-])" % _OTHER
#: Other spacings count where no printed number begins at one of their groups.
_CARD = rf"(?<![A-Za-z0-9.-])(?:{_PRINTED}|(?!(?:[0-9]{{1,12}}[ -]){{1,6}}{_PRINTED})[0-9](?:[ -]?[0-9]){{12,18}}(?![A-Za-z0-9-]))"

#: Where the country's code of a number without gaps ends.
_COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Formats that are looked for, as Java regular expressions.  A match that fails its validation stays.  Repeated groups are
#: bounded, as each turn of one takes a frame of the matcher's stack.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "date": r"(?<![A-Za-z0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?!(?!T[0-9]{2}:[0-9]{2})[A-Za-z0-9/-])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "phone": "|".join((_PHONE, r"(?<![A-Za-z0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])", r"(?<![A-Za-z0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9-])")),
    "card": _CARD,
}
ANY = "|".join(FORMATS.values())
#: Values a date has: the 146097 days of 400 years from 1800 on, as 189 * 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def _prf(key: str, tweak: Column, turn: Column, value: Column) -> Column:
    """Hex digest that only the key's owner can compute."""
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), value.cast("string")), 256)


def feistel_text(value: Column, alphabet: str, key: str, tweak: Column, invert: bool = False) -> Column:
    """A keyed permutation of the strings over alphabet of value's length (at most 64 characters)."""
    half = F.ceil(F.length(value) / 2).cast("int")

    def shifted(part: Column, other: Column, turn: Column) -> Column:
        digest = _prf(key, tweak, turn, other)

        def one(c: Column, j: Column) -> Column:
            byte = F.conv(F.substring(digest, F.pmod(j, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            at = F.instr(F.lit(alphabet), c) - 1 + (-byte if invert else byte)
            return F.substring(F.lit(alphabet), F.pmod(at, F.lit(len(alphabet))) + 1, F.lit(1))

        return F.when(F.length(part) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.split(part, ""), one), ""))

    def turned(s: Column, i: Column) -> Column:
        left, right = s.getField("l"), s.getField("r")
        odd = i % 2 == 1
        return F.struct(F.when(odd, shifted(left, right, i)).otherwise(left).alias("l"), F.when(odd, right).otherwise(shifted(right, left, i)).alias("r"))

    turns = F.sequence(F.lit(ROUNDS), F.lit(1)) if invert else F.sequence(F.lit(1), F.lit(ROUNDS))
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    return F.aggregate(turns, start, turned, lambda s: F.concat(s.getField("l"), s.getField("r")))


def feistel_number(value: Column, a: int, b: int, key: str, tweak: Column, invert: bool = False) -> Column:
    """A keyed permutation of the integers 0 .. a * b - 1."""

    def noise(turn: Column, other: Column, size: int) -> Column:
        n = F.pmod(F.conv(F.substring(_prf(key, tweak, turn, other), 1, 15), 16, 10).cast("long"), F.lit(size))
        return -n if invert else n

    def turned(s: Column, i: Column) -> Column:
        left, right = s.getField("l"), s.getField("r")
        odd = i % 2 == 1
        return F.struct(F.when(odd, F.pmod(left + noise(i, right, a), F.lit(a))).otherwise(left).alias("l"), F.when(odd, right).otherwise(F.pmod(right + noise(i, left, b), F.lit(b))).alias("r"))

    turns = F.sequence(F.lit(ROUNDS), F.lit(1)) if invert else F.sequence(F.lit(1), F.lit(ROUNDS))
    value = value.cast("long")
    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(turns, start, turned, lambda s: s.getField("l") * b + s.getField("r"))


def _only(match: Column, chars: str) -> Column:
    return F.regexp_replace(match, f"[^{chars}]", "")


def _refill(match: Column, chars: str, new: Column) -> Column:
    """match with its characters of a class replaced by those of new, in order."""

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike(f"^[{chars}]$")
        return F.struct(F.concat(s.getField("out"), F.when(hit, F.substring(new, s.getField("k"), F.lit(1))).otherwise(c)).alias("out"), (s.getField("k") + hit.cast("int")).alias("k"))

    return F.aggregate(F.split(match, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda s: s.getField("out"))


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a number whose check digit is the last."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda s, x: s + x,
    )


def _mod97(text: Column) -> Column:
    """Remainder by 97 of an account number, its first four characters moved to the end and letters as 10-35."""
    turned = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("string")).otherwise((F.ascii(c) - 55).cast("string"))
    number = F.array_join(F.transform(F.split(turned, ""), value), "")
    return F.aggregate(F.split(number, ""), F.lit(0), lambda s, c: (s * 10 + c.cast("int")) % 97)


def _email(m: Column, key: str, invert: bool) -> Column:
    local = F.substring_index(m, "@", 1)
    low = F.lower(local)
    new = _refill(low, "a-z", feistel_text(_only(low, "a-z"), LETTERS, key, F.lit("mail a"), invert))
    new = _refill(new, "0-9", feistel_text(_only(low, "0-9"), DIGITS, key, F.lit("mail 0"), invert))
    cased = F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(F.substring(local, i + 1, F.lit(1)).rlike("^[A-Z]$"), F.upper(c)).otherwise(c)), "")
    return F.concat(cased, F.substring(m, F.length(local) + 1, F.length(m)))


def _iban(m: Column, key: str, invert: bool) -> Column:
    bare = F.regexp_replace(m, " ", "")
    land, body = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))
    body = _refill(body, "0-9", feistel_text(_only(body, "0-9"), DIGITS, key, F.concat(F.lit("iban "), land), invert))
    check = F.lpad((98 - _mod97(F.concat(land, F.lit("00"), body))).cast("string"), 2, "0")
    return F.when(_mod97(bare) == 1, _refill(m, "A-Z0-9", F.concat(land, check, body))).otherwise(m)


def _ip(m: Column, key: str, invert: bool) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = feistel_number(number, 1 << 16, 1 << 16, key, F.lit("ip"), invert)
    text = F.array_join(F.transform(F.array(*[F.lit(x) for x in (1 << 24, 1 << 16, 1 << 8, 1)]), lambda d: F.pmod(F.floor(new / d), F.lit(256)).cast("string")), ".")
    return F.when(F.forall(part, lambda x: x <= 255), text).otherwise(m)


def _date(m: Column, key: str, invert: bool) -> Column:
    sep = F.when(m.rlike("-"), "-").when(m.rlike("/"), "/").otherwise(".")
    part = F.split(m, "[-/.]")
    one, two, three = (part.getItem(k) for k in range(3))
    year_first = F.length(one) == 4
    month_first = (sep == "/") & ~year_first & (two.cast("int").between(1, 31)) & (one.cast("int") <= 12)
    year = F.when(year_first, one).otherwise(three)
    month = F.when(year_first, two).when(month_first, one).otherwise(two)
    day = F.when(year_first, three).when(month_first, two).otherwise(one)
    number = F.datediff(F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel_number(number, *DAYS, key, F.lit("date"), invert).cast("int"))
    padded = year_first | ((F.length(one) == 2) & (F.length(two) == 2))
    field = lambda pattern: F.when(padded, F.date_format(new, pattern * 2)).otherwise(F.date_format(new, pattern))
    y = F.date_format(new, "yyyy")
    text = F.when(year_first, F.concat_ws("-", y, field("M"), field("d"))).when(month_first, F.concat_ws("-", field("M"), field("d"), y)).otherwise(F.concat_ws("-", field("d"), field("M"), y))
    return F.when(number.between(0, DAYS[0] * DAYS[1] - 1), F.replace(text, F.lit("-"), sep)).otherwise(m)


def _ssn(m: Column, key: str, invert: bool) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    right = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    new = feistel_number(index * 9999 + serial - 1, 898 * 99, 9999, key, F.lit("ssn"), invert)
    high = F.floor(new / 9999)
    a = F.floor(high / 99) + 1
    a = a + F.when(a >= 666, 1).otherwise(0)
    two = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.when(right, F.concat_ws("-", two(a, 3), two(F.pmod(high, F.lit(99)) + 1, 2), two(F.pmod(new, F.lit(9999)) + 1, 4))).otherwise(m)


def _phone(m: Column, key: str, invert: bool) -> Column:
    land = F.regexp_extract(m, rf"^(\+[0-9]{{1,3}}(?=[ .(-])|{_COUNTRY})?", 1)  # the country's code stays
    rest = F.substring(m, F.length(land) + 1, F.length(m))
    digits = _only(rest, "0-9")
    return F.when(F.length(_only(m, "0-9")).between(7, 15), F.concat(land, _refill(rest, "0-9", feistel_text(digits, DIGITS, key, F.lit("phone"), invert)))).otherwise(m)


def _card(m: Column, key: str, invert: bool) -> Column:
    """Of fours with more digits beside them the first sixteen digits are the card where they pass, then the last sixteen, then all."""
    fours = m.rlike("^[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,4}$")
    passes = lambda part: _luhn_sum(_only(part, "0-9")) % 10 == 0
    first, last = F.substring(m, 1, 19), F.substring(m, 6, 19)
    start = F.when(fours & ~passes(first) & (F.length(m) == 24) & passes(last), 6).otherwise(1)
    width = F.when(fours & (passes(first) | (F.length(m) == 24)), 19).otherwise(F.length(m))
    part = F.substring(m, start, width)
    return F.concat(F.substring(m, F.lit(1), start - 1), _card_number(part, key, invert), F.substring(m, start + width, F.length(m)))


def _card_number(m: Column, key: str, invert: bool) -> Column:
    digits = _only(m, "0-9")
    first, body = F.substring(digits, 1, 1), F.substring(digits, F.lit(2), F.length(digits) - 2)
    new = F.concat(first, feistel_text(body, DIGITS, key, F.concat(F.lit("card "), first), invert))
    check = F.pmod(-_luhn_sum(F.concat(new, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(_luhn_sum(digits) % 10 == 0, _refill(m, "0-9", F.concat(new, check))).otherwise(m)


def pseudonym(match: Column, key: str, invert: bool = False) -> Column:
    """The pseudonym of a text that one of FORMATS matches; itself where the format's validation fails."""
    whole = lambda name: match.rlike("^(?:" + FORMATS[name] + ")$")
    return (
        F.when(match.contains("@"), _email(match, key, invert))
        .when(whole("iban"), _iban(match, key, invert))
        .when(whole("ip"), _ip(match, key, invert))
        .when(whole("date"), _date(match, key, invert))
        .when(whole("ssn"), _ssn(match, key, invert))
        .when(whole("phone"), _phone(match, key, invert))
        .otherwise(_card(match, key, invert))
    )


def secret(spark: SparkSession) -> str:
    """The key that the session's KEY names; where it names none, one drawn at random for this application.

    Pseudonyms under a random key link values within the application's results
    only, and nobody can turn them back.
    """
    return spark.conf.get(KEY, None) or _drawn(spark.sparkContext.applicationId)


@lru_cache(maxsize=4)
def _drawn(application: str) -> str:
    return secrets.token_hex(32)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, invert: bool = False) -> DataFrame:
    """docs with the personal data in text_col replaced; other columns, rows and their order in partitions stay.

    count_col: a further column with the number of replaced values.  Null texts
    stay null and count 0; texts without a digit or @ are not searched at all.
    Repeated rows change alike, an empty table stays empty, and columns of any
    other name are kept.  invert: turns pseudonyms under the same key back.
    """
    text = F.col(text_col)
    found_, new_ = unused(docs, "found"), unused(docs, "new")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)))
    # evaluated once a row: both are inputs of the projections above
    rows = docs.withColumn(found_, found)
    rows = rows.withColumn(new_, F.when(F.size(found_) > 0, F.transform(found_, lambda m: pseudonym(m, key, invert))))
    gaps = F.split(text, ANY, -1)
    spelled = F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get(F.col(new_), i), F.lit(""))))), "")
    changed = F.coalesce(F.size(F.filter(F.zip_with(found_, new_, lambda a, b: a != b), lambda x: x)), F.lit(0))
    if count_col:
        rows = rows.withColumn(count_col, F.when(F.col(new_).isNull(), F.lit(0)).otherwise(changed).cast("long"))
    return rows.withColumn(text_col, F.when(F.col(new_).isNull(), text).otherwise(spelled)).drop(found_, new_)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_replaced) of every document, under the session's key (see secret).  A null text stays null with 0."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), secret(spark), count_col="n_replaced")
