"""Format-preserving pseudonyms for personal data, with DataFrame functions alone.

Candidates are found by one regular expression and validated by kind: card numbers by their check digit, IP addresses
and dates by range, social security numbers by their blank ranges, telephone numbers by their digits. A value becomes
the number of its place among all values of its format; a keyed Feistel network with modular addition permutes that
domain, so a pseudonym has the same format and is valid, equal values stay equal in all documents, and whoever has
the key can turn them back. The key is an argument; the query takes it from the session. Separators, country codes and check digits stay what they must be. The name and domain of
an e-mail address become keyed digests (there is no number to permute), its top domain stays.

Nulls: a null text stays null, an empty one empty. What fails its validation, and all other text, stays as it is. Where
patterns overlap the first one to begin wins, then the first of the kinds. Repeated rows get equal pseudonyms. A very long
text is one row of the plan, with an array of its values. An empty table has an empty result; a column of the documents named
found is replaced, all others stay.
"""

from __future__ import annotations

import secrets
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds of the network, and the setting of the session that holds the query's key.
ROUNDS, KEY_SETTING = 10, "spark.metaloom.pii.secret"
#: Days from 1800-01-01 on in 400 years, as a product: the domain of dates.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
#: Steps after which a walk for a date that must read day first ends; it needs so many with probability 0.4 ** 64.
WALK = 64

#: Kinds in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[\-.][0-9]{3}[\-.][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: All numbers and dates start with one of these characters; the look-ahead spares the others the alternatives.
NUMBERS = "(?=[0-9+(])(?:" + "|".join(p for name, p in PATTERNS.items() if name != "email") + ")"
ANY = f"{NUMBERS}|{PATTERNS['email']}"


def _number(c: Column) -> Column:
    return c.cast("bigint")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pad(c: Column, width: Column | int) -> Column:
    """A number as text of at least that width, with zeros before it."""
    text = c.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest((F.lit(width) if isinstance(width, int) else width) - F.length(text), F.lit(0))), text)


def permuted(left: Column, right: Column, a: Column | int, b: Column | int, key: Column | str, name: str, reverse: bool = False) -> Column:
    """A struct (l, r): the pair left < a, right < b through the keyed network; reverse undoes it."""
    a, b = ((F.lit(x) if isinstance(x, int) else x).cast("bigint") for x in (a, b))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(name), a, b, i, F.when(even, s["r"]).otherwise(s["l"])).cast("binary"), 256)
        shift = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") * (-1 if reverse else 1)
        return F.struct(F.when(even, F.pmod(s["l"] + shift, a)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(F.pmod(s["r"] + shift, b)).alias("r"))

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if reverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, F.struct(_number(left).alias("l"), _number(right).alias("r")), step)


def digits_permuted(digits: Column, key: Column | str, name: str, reverse: bool = False) -> Column:
    """A text of 2 to 36 digits permuted among all texts of its length."""
    u = F.floor(F.length(digits) / 2).cast("int")
    v = F.length(digits) - u
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("bigint")
    halves = F.struct(F.substring(digits, F.lit(1), u).alias("l"), F.substring(digits, u + 1, v).alias("r"), power(u).alias("a"), power(v).alias("b"))
    made = let(halves, lambda h: permuted(h["l"], h["r"], h["a"], h["b"], key, name, reverse))
    return let(made, lambda s: F.concat(_pad(s["l"], u), _pad(s["r"], v)))


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def in_format(value: Column, digits: Column) -> Column:
    """value with its digits replaced by others, one by one."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["text"], F.when(digit, F.substring(digits, s["next"], F.lit(1))).otherwise(c)).alias("text"), (s["next"] + digit.cast("int")).alias("next"))

    return F.aggregate(F.split(value, ""), start, step, lambda s: s["text"])


def luhn(digits: Column) -> Column:
    """The Luhn sum of a text of digits; of a valid number it ends in 0."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)


def _card(value: Column, key: Column | str, reverse: bool) -> tuple[Column, Column]:
    digits = only_digits(value)
    body = let(F.substring(digits, F.lit(1), F.length(digits) - 1), lambda d: digits_permuted(d, key, "card", reverse))
    whole = let(body, lambda x: F.concat(x, let(F.concat(x, F.lit("0")), lambda y: F.pmod(10 - luhn(y), F.lit(10))).cast("string")))
    return let(digits, luhn) % 10 == 0, let(whole, lambda d: in_format(value, d))


def _phone(value: Column, key: Column | str, reverse: bool) -> tuple[Column, Column]:
    def made(digits: Column) -> Column:
        country = F.when(~value.startswith("+"), 0).when(digits.startswith("1") | digits.startswith("7"), 1).otherwise(2)
        own = let(F.substring(digits, country + 1, F.length(digits) - country), lambda d: digits_permuted(d, key, "phone", reverse))
        return F.concat(F.substring(digits, F.lit(1), country), own)

    size = F.length(only_digits(value))
    return (size >= 7) & (size <= 15), let(let(only_digits(value), made), lambda d: in_format(value, d))


def _ssn(value: Column, key: Column | str, reverse: bool) -> tuple[Column, Column]:
    part = [_number(F.substring(value, i, n)) for i, n in ((1, 3), (5, 2), (8, 4))]
    valid = (part[0] > 0) & (part[0] < 900) & (part[0] != 666) & (part[1] > 0) & (part[2] > 0)
    area = part[0] - 1 - (part[0] > 666).cast("int")

    def text(s: Column) -> Column:
        new = s["l"] + 1
        return F.concat_ws("-", _pad(new + (new >= 666).cast("int"), 3), _pad(F.floor(s["r"] / 9999) + 1, 2), _pad(s["r"] % 9999 + 1, 4))

    return valid, let(permuted(area, (part[1] - 1) * 9999 + part[2] - 1, 898, 99 * 9999, key, "ssn", reverse), text)


def _ip(value: Column, key: Column | str, reverse: bool) -> tuple[Column, Column]:
    part = [_number(F.split_part(value, F.lit("."), F.lit(i))) for i in range(1, 5)]
    made = permuted(part[0] * 256 + part[1], part[2] * 256 + part[3], 65536, 65536, key, "ip", reverse)
    valid = reduce(lambda x, y: x & y, [p <= 255 for p in part])
    return valid, let(made, lambda s: F.concat_ws(".", *(f for h in ("l", "r") for f in (F.floor(s[h] / 256), s[h] % 256))))


def _date(value: Column, key: Column | str, reverse: bool) -> tuple[Column, Column]:
    """Year first; else month first with / (day first if that is no date), day first with - and dots.

    A date with / that can only read day first is permuted again until its pseudonym can only read so too; otherwise
    two dates could share a pseudonym.
    """
    mark = F.regexp_extract(value, "[-/.]", 0)
    part = [F.regexp_extract(value, r"^([0-9]+)[-/.]([0-9]+)[-/.]([0-9]+)$", i) for i in (1, 2, 3)]
    year_first, month_first = F.length(part[0]) == 4, (mark == "/") & (_number(part[0]) <= 12)
    year = F.when(year_first, part[0]).otherwise(part[2])
    month = F.when(year_first | ~month_first, part[1]).otherwise(part[0])
    day = F.when(year_first, part[2]).when(month_first, part[1]).otherwise(part[0])
    when = F.try_to_timestamp(F.concat_ws("-", year, _pad(_number(month), 2), _pad(_number(day), 2)), F.lit("yyyy-MM-dd")).cast("date")
    place = F.date_diff(when, F.lit(FIRST_DAY).cast("date"))
    valid = when.isNotNull() & (place >= 0) & (place < DAYS[0] * DAYS[1])

    def text(new: Column) -> Column:
        y, m, d = F.year(new).cast("string"), _pad(F.month(new), F.length(month)), _pad(F.day(new), F.length(day))
        return F.when(year_first, F.concat(y, mark, m, mark, d)).when(month_first, F.concat(m, mark, d, mark, y)).otherwise(F.concat(d, mark, m, mark, y))

    day_of = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
    free = year_first | month_first | (mark != "/")

    def step(s: Column, _: Column) -> Column:
        once = let(permuted(F.floor(s["n"] / DAYS[1]), s["n"] % DAYS[1], *DAYS, key, "date", reverse), lambda p: p["l"] * DAYS[1] + p["r"])
        return F.when(s["done"], s).otherwise(let(once, lambda n: F.struct(n.alias("n"), (free | (F.day(day_of(n)) > 12)).alias("done"))))

    moved = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(_number(place).alias("n"), F.lit(False).alias("done")), step, lambda s: s["n"])
    return valid, let(let(moved, day_of), text)


def _email(value: Column, key: Column | str, reverse: bool) -> tuple[Column, Column]:
    low = F.lower(value)
    digest = lambda name, c: F.sha2(F.concat_ws("|", F.lit(key), F.lit(name), c).cast("binary"), 256)
    domain = F.substring_index(low, "@", -1)
    return F.lit(not reverse), F.concat(F.lit("u"), F.substring(digest("name", low), 1, 16), F.lit("@d"), F.substring(digest("domain", domain), 1, 10), F.lit("."), F.substring_index(domain, ".", -1))


_KINDS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: Column | str, reverse: bool = False) -> Column:
    """A struct (kind, text) for a candidate; kind is null and text the value itself where no validation holds."""
    made = {name: make(value, key, reverse) for name, make in _KINDS.items()}
    kind = F.lit(None).cast("string")
    for name in reversed(made):
        kind = F.when(value.rlike(f"^(?:{PATTERNS[name]})$"), F.when(made[name][0], F.lit(name))).otherwise(kind)

    def text(known: Column) -> Column:
        out = value
        for name in reversed(made):
            out = F.when(known == name, made[name][1]).otherwise(out)
        return F.struct(known.alias("kind"), out.alias("text"))

    return let(kind, text)


def pseudonymise(documents: DataFrame, *, key: str, text: str = "text", reverse: bool = False) -> DataFrame:
    """The rows with the text's personal data replaced, and with found (in place of any such column): the kinds replaced, in order.

    reverse turns numbers and dates back with the same key; addresses cannot be turned back.
    """
    whole = F.col(text)
    # Names for steps that no column of the documents has.
    mark = "_" * (2 + max(len(c) - len(c.lstrip("_")) for c in documents.columns))
    pattern_, values_, made_, key_ = (f"{mark}{x}" for x in ("pattern", "values", "made", "key"))
    # Texts without @ need no pattern for addresses, those without digits none for numbers.
    pattern = F.when(whole.contains("@"), F.lit(ANY)).when(whole.rlike("[0-9]"), F.lit(NUMBERS))
    # The key is a broadcast row, not a literal: plans, the UI and event logs show literals.
    keys = documents.sparkSession.createDataFrame([(key,)], f"{key_} string")
    step = documents.withColumn(pattern_, pattern).crossJoin(F.broadcast(keys))
    step = step.withColumn(values_, F.when(F.col(pattern_) == ANY, F.regexp_extract_all(whole, F.lit(ANY), F.lit(0))).when(F.col(pattern_).isNotNull(), F.regexp_extract_all(whole, F.lit(NUMBERS), F.lit(0))))
    step = step.withColumn(made_, F.when(F.size(values_) > 0, F.transform(values_, lambda v: pseudonym(v, F.col(key_), reverse))))
    pieces = F.zip_with(F.when(F.col(pattern_) == ANY, F.split(whole, ANY, -1)).otherwise(F.split(whole, NUMBERS, -1)), F.concat(F.transform(made_, lambda m: m["text"]), F.array(F.lit(""))), lambda gap, made: F.concat(gap, made))
    kinds = F.filter(F.transform(made_, lambda m: m["kind"]), lambda k: k.isNotNull())
    done = step.withColumn(text, F.when(F.col(made_).isNotNull(), F.array_join(pieces, "")).otherwise(whole))
    return done.withColumn("found", F.coalesce(kinds, F.array().cast("array<string>"))).drop(pattern_, values_, made_, key_)


def session_key(spark: SparkSession) -> str:
    """The key that the session states. Where it states none, a new one that is kept nowhere: equal values are linked
    within what is made with it, but not with other results, and nobody can turn them back; a warning says so. Spark
    redacts settings of that name where it shows them."""
    stated = spark.conf.get(KEY_SETTING, "")
    if not stated:
        warnings.warn(f"{KEY_SETTING} is not set: a new key links values within this result alone", stacklevel=2)
    return stated or secrets.token_hex(32)


def op8(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = pseudonymise(documents, key=session_key(spark))
    count = lambda name: F.size(F.filter("found", lambda k: k == name)).cast("bigint").alias(f"n_{name}")
    return done.select("doc_id", "text", F.size("found").cast("bigint").alias("n_found"), *(count(k) for k in _KINDS))
