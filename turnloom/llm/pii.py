"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by pattern, validated (Luhn digit, calendar, octets) and replaced by a keyed
permutation of their own format: a Feistel network over two halves of digits, days, octets or
characters. Each round adds a keyed hash of one half to the other, so the network is a
permutation whatever the hash is: unequal values stay unequal, and an equal value gets an equal
pseudonym in every document, which keeps documents linked. Nothing is looked up or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import fresh

ROUNDS = 10

#: Fixed patterns of the values, in the order in which they are tried at a place. Runs are possessive
#: and begin where no such run is entered, so that a long run without "@" is read once.
PATTERNS = {
    "email": r"(?:(?<![\p{L}\p{N}._%+\-])|\G)[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ ]?|\d{3}[.\-])\d{3}[ .\-]\d{4}(?!\w)",
    "abroad": r"(?<![\w.])\+(?=(?:[ .\-]?\d){8})\d{1,3}(?:[ .\-]\d{2,5}){2,4}(?![\w])(?!\.\d)",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d|[\p{L}_])",
    "date": r"(?<![\w\-/])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\w\-/])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w\-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4})(?![\w\-])",
    "secret": r"(?<!\w)(?=[A-Fa-f]*\d)(?:[0-9a-f]{32}(?:[0-9a-f]{8}|[0-9a-f]{32})?|[0-9A-F]{32}(?:[0-9A-F]{8}|[0-9A-F]{32})?)(?!\w)",
    "access_key": r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)",
    "token": r"(?<!\w)gh[pousr]_[A-Za-z0-9]{36}(?!\w)",
    "assigned": r"(?<!\w)(?i:password|passwd|pwd|secret|api_?key)\s*[=:]\s*[^\s\",;]{6,}",
}
ANY = "|".join(PATTERNS.values())

#: Days from 1800-01-01 to 2199-12-31: the 400 years of the calendar's cycle, 27 * 5411.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 27, 5411
#: Of these, days after the twelfth of their month: 9 * 9833 in 4,800 months.
LATE_A, LATE_B, LATE_A_MONTH = 9, 9833, 9 * 9833 / 4800


def keyed(key: str, *parts: Column) -> Column:
    """60 bits of a nested keyed SHA-256 as a long."""
    inner = F.sha2(F.concat_ws(":", F.lit(key), *parts), 256)
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), inner), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tweak: Column, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """struct<a, b>: a permutation of the pairs below (size_a, size_b), one half a round."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(pair: Column, i: Column) -> Column:
        even, half = i % 2 == 0, F.when(i % 2 == 0, pair["b"]).otherwise(pair["a"])
        added = keyed(key, tweak, i.cast("string"), half.cast("string"))
        return F.struct(
            F.when(even, F.pmod(pair["a"] + added, size_a)).otherwise(pair["a"]).alias("a"),
            F.when(even, pair["b"]).otherwise(F.pmod(pair["b"] + added, size_b)).alias("b"),
        )

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)


def _power(base: int, n: Column) -> Column:
    return F.pow(F.lit(float(base)), n.cast("double")).cast("long")


def _digits(number: Column, n: Column) -> Column:
    return F.lpad(number.cast("string"), n, "0")


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A permutation of the digit strings of one length (2 to 36 digits)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = (n - u).cast("int")
    pair = feistel(
        key,
        F.concat(F.lit(kind), n.cast("string")),
        F.substr(digits, F.lit(1), u),
        F.substr(digits, u + 1, v),
        _power(10, u),
        _power(10, v),
    )
    made = F.transform(F.array(pair), lambda p: F.concat(_digits(p["a"], u), _digits(p["b"], v)))
    return made[0]


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; ``doubled`` is 1 if every second digit counted from the second last doubles
    (a whole number), 0 if from the last (a number that lacks its check digit)."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + worth(i))


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def place(made: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(made["out"], F.when(is_digit, F.substr(digits, made["at"], F.lit(1))).otherwise(c)).alias("out"),
            (made["at"] + is_digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(form, ""), start, place, lambda made: made["out"])


def _one(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, whatever ``f`` does with it."""
    return F.transform(F.array(value), f)[0]


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def card(key: str, value: Column) -> Column:
    """The number without its check digit is permuted; the check digit is made anew."""

    def made(digits: Column) -> Column:
        body = permuted_digits(key, "card", F.substr(digits, F.lit(1), F.length(digits) - 1))
        return _one(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string")))

    return _one(_bare(value), lambda d: F.when(luhn_sum(d, 1) % 10 == 0, _refill(value, made(d))).otherwise(value))


def phone(key: str, value: Column) -> Column:
    """The last ten digits are permuted; the country code and the punctuation stay."""

    def made(digits: Column) -> Column:
        code = F.substr(digits, F.lit(1), F.length(digits) - 10)
        return F.concat(code, permuted_digits(key, "phone", F.substr(digits, F.length(digits) - 9, F.lit(10))))

    return _one(_bare(value), lambda d: _refill(value, made(d)))


def abroad(key: str, value: Column) -> Column:
    """A number with a country code, which stays, in groups of digits, which are permuted."""
    code = F.regexp_extract(value, r"^\+\d+[ .\-]", 0)
    rest = F.substr(value, F.length(code) + 1)
    return F.concat(code, _one(_bare(rest), lambda d: _refill(rest, permuted_digits(key, "abroad", d))))


def token(key: str, value: Column) -> Column:
    """A token of a code host: the four characters at its front stay."""
    return F.concat(F.left(value, F.lit(4)), permuted_text(key, "token", F.substr(value, F.lit(5))))


def ssn(key: str, value: Column) -> Column:
    return _one(_bare(value), lambda d: _refill(value, permuted_digits(key, "ssn", d)))


def ip(key: str, value: Column) -> Column:
    """Four octets are permuted as two halves of 16 bits; other dotted numbers stay."""

    def made(o: Column) -> Column:
        pair = feistel(key, F.lit("ip"), o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
        octets = lambda p: [F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256]
        return _one(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in octets(p)]))

    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    return _one(octets, lambda o: F.when(F.forall(o, lambda x: x <= 255), made(o)).otherwise(value))


def date(key: str, value: Column) -> Column:
    """A day of the 400-year cycle is permuted within the days that its spelling can hold.

    With slashes the month comes first if that gives a day. Spellings that only hold with the
    day first have a day after the twelfth, and such days are permuted among themselves, so no
    pseudonym is read in the other order.
    """
    start = F.lit(FIRST_DAY).cast("date")
    iso = value.rlike("^[0-9]{4}-")
    day = lambda form: F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), start)

    def made(n: Column, form: str) -> Column:
        pair = feistel(key, F.lit("date"), F.floor(n / DAYS_B), n % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B))
        new = _one(pair, lambda p: F.date_format(F.date_add(start, (p["a"] * DAYS_B + p["b"]).cast("int")), form))
        return F.when((n >= 0) & (n < DAYS_A * DAYS_B), new).otherwise(value)

    def late(n: Column) -> Column:
        on = F.date_add(start, n)
        rank = n - 12 * ((F.year(on) - int(FIRST_DAY[:4])) * 12 + F.month(on))
        pair = feistel(key, F.lit("late date"), F.floor(rank / LATE_B), rank % LATE_B, F.lit(LATE_A), F.lit(LATE_B))
        new = _one(_one(pair, lambda p: p["a"] * LATE_B + p["b"]), lambda r: F.date_format(_late_day(start, r), "dd/MM/yyyy"))
        return F.when((n >= 0) & (n < DAYS_A * DAYS_B), new).otherwise(value)

    forms = (day("yyyy-MM-dd"), day("MM/dd/yyyy"), day("dd/MM/yyyy"))
    return F.when(iso, _one(forms[0], lambda n: F.coalesce(made(n, "yyyy-MM-dd"), value))).otherwise(
        _one(
            F.struct(forms[1].alias("us"), forms[2].alias("eu")),
            lambda n: F.when(n["us"].isNotNull(), made(n["us"], "MM/dd/yyyy")).when(n["eu"].isNotNull(), late(n["eu"])).otherwise(value),
        )
    )


def _late_day(start: Column, rank: Column) -> Column:
    """The day of that rank among the days after the twelfth of their month."""
    guess = F.floor(rank / LATE_A_MONTH)
    before = lambda m: F.datediff(F.add_months(start, m.cast("int")), start) - 12 * m
    months = F.filter(F.sequence(F.greatest(guess - 1, F.lit(0)), guess + 1), lambda m: before(m) <= rank)
    return _one(F.array_max(months), lambda m: F.date_add(F.add_months(start, m.cast("int")), (12 + rank - before(m)).cast("int")))


def secret(key: str, value: Column) -> Column:
    """Hexadecimal keys, eight digits at a time, each place with a permutation of its own."""
    upper = value.rlike("[A-F]")
    n = (F.length(value) / 8).cast("int")

    def chunk(i: Column) -> Column:
        part = F.substr(value, i * 8 + 1, F.lit(8))
        half = lambda at: F.conv(F.substr(part, F.lit(at), F.lit(4)), 16, 10)
        pair = feistel(
            key, F.concat(F.lit("secret"), i.cast("string")), half(1), half(5), F.lit(65536), F.lit(65536)
        )
        return _one(pair, lambda p: F.concat(F.lpad(F.hex(p["a"]), 4, "0"), F.lpad(F.hex(p["b"]), 4, "0")))

    made = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), chunk), "")
    return F.when(upper, made).otherwise(F.lower(made))


def permuted_text(key: str, kind: str, value: Column) -> Column:
    """Letters and digits of ASCII move within their class, all else stays: the halves of the
    text are moved in turn by a keyed hash of the other half."""

    def move(key_hash: Column, half: Column) -> Column:
        def at(c: Column, i: Column) -> Column:
            by = F.conv(F.substr(key_hash, i % 31 * 2 + 1, F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)
            shifted = lambda first, size: F.char(F.pmod(code - first + by, F.lit(size)) + first)
            return (
                F.when(c.rlike("^[a-z]$"), shifted(97, 26))
                .when(c.rlike("^[A-Z]$"), shifted(65, 26))
                .when(c.rlike("^[0-9]$"), shifted(48, 10))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(half, ""), at), "")

    def turn(pair: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, pair["b"]).otherwise(pair["a"])
        key_hash = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), other), 256)
        moved = _one(key_hash, lambda h: move(h, F.when(even, pair["a"]).otherwise(pair["b"])))
        return F.struct(
            F.when(even, moved).otherwise(pair["a"]).alias("a"),
            F.when(even, pair["b"]).otherwise(moved).alias("b"),
        )

    cut = F.ceil(F.length(value) / 2).cast("int")
    halves = F.struct(F.substr(value, F.lit(1), cut).alias("a"), F.substr(value, cut + 1, F.length(value)).alias("b"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), halves, turn, lambda p: F.concat(p["a"], p["b"]))


def email(key: str, value: Column) -> Column:
    """What stands before the @ is permuted; the rest of the address stays."""
    local = permuted_text(key, "email", F.substring_index(value, "@", 1))
    return F.concat(local, F.lit("@"), F.substring_index(value, "@", -1))


def access_key(key: str, value: Column) -> Column:
    """A cloud access key: the four letters at its front stay."""
    return F.concat(F.left(value, F.lit(4)), permuted_text(key, "access", F.substr(value, F.lit(5))))


def assigned(key: str, value: Column) -> Column:
    """ "password=..." and the like: the name and the sign stay."""
    name = F.regexp_extract(value, r"^\w+\s*[=:]\s*", 0)
    return F.concat(name, permuted_text(key, "assigned", F.substr(value, F.length(name) + 1)))


MAKERS = {"email": email, "phone": phone, "ip": ip, "date": date, "ssn": ssn, "card": card}
MAKERS |= {"abroad": abroad, "token": token, "secret": secret, "access_key": access_key, "assigned": assigned}


def pseudonym(key: str, value: Column) -> Column:
    """The pseudonym of a found value, or the value itself if it isn't valid."""
    chosen = None
    for kind, pattern in PATTERNS.items():
        # A found value stands alone here, so what may surround it is no longer looked at.
        test, made = value.rlike(f"^(?:{pattern})$"), MAKERS[kind](key, value)
        chosen = F.when(test, made) if chosen is None else chosen.when(test, made)
    return chosen.otherwise(value)


def pseudonymised(df: DataFrame, key: str, text_col: str = "text", count_col: str = "n_pii") -> DataFrame:
    """``df`` with pseudonyms in ``text_col`` and the number of replaced values in ``count_col``.

    A null text stays null with count 0, and so does an empty one. Values that fail validation
    are left alone and not counted. Other columns and repeated rows pass through; a column named
    ``count_col`` is replaced.
    """
    df = df.drop(count_col)
    found_col, made_col = fresh(df, "found", "made")
    text = F.col(text_col)
    found = F.when(text.rlike("[0-9@=:]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    with_found = df.withColumn(found_col, found)
    some = F.size(found_col) > 0
    made = F.when(some, F.transform(found_col, lambda v: pseudonym(key, v)))
    with_made = with_found.withColumn(made_col, made)
    joined = F.array_join(
        F.zip_with(F.split(text, ANY, -1), made_col, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), ""
    )
    changed = F.size(F.filter(F.zip_with(found_col, made_col, lambda a, b: a != b), lambda x: x))
    return with_made.withColumns(
        {
            count_col: F.when(some, changed).otherwise(0).cast("long"),
            text_col: F.when(some, joined).otherwise(text),
        }
    ).drop(found_col, made_col)

