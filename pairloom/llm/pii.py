"""PII: numbers, dates, addresses and keys replaced by keyed pseudonyms of the same format.

A value that passes the checks of its kind is permuted within the values of that kind by a Feistel network
under a key. Equal values so get equal pseudonyms in every document, different values different ones, and
a reader of the result finds a card number where one stood. Everything is built from column functions.

Fixed values of this module: the patterns and ranges below.

======== ============================================ ============================== ==============================
kind     format                                       check                          permuted
======== ============================================ ============================== ==============================
email    local@domain                                 shape                          letters, digits of local part
ssn      ddd-dd-dddd                                  area, group, serial not zero   all nine digits
phone    +1 (ddd) ddd-dddd and with dots, dashes      area and exchange start 2-9    seven digits (area stays)
date     yyyy-mm-dd, dd/mm/yyyy, mm/dd/yyyy, dd.mm.yyyy   a day from 1900 to 2099        the day, within these years
ip       d.d.d.d                                      parts up to 255                the 32 bits
iban     two letters, two digits, 11 to 30 more       remainder 97                   digits after the check digits
card     13 to 19 digits, in groups or not            Luhn                           all but the check digit
key      AKIA..., gh?_..., sk-...                     shape                          letters and digits
secret   password=, api_key: and the like             shape                          letters and digits
======== ============================================ ============================== ==============================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
DAYS = 73_049

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
SECRET = r"(?i:(?:[a-z]{1,20}_)?(?:password|passwd|pwd|secret|token|api[_-]?key))[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/.-]{8,}"
KEY = r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])"
# Characters of an IBAN by country; of others any number from 15 to 34 is taken.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
KNOWN = "|".join(c for names in IBAN_LENGTHS.values() for c in names.split())
IBAN = (
    r"\b(?:" + "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
    + rf"|(?!{KNOWN})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])"
)
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|-[0-9])"

KINDS = {"email": EMAIL, "secret": SECRET, "key": KEY, "iban": IBAN, "date": DATE, "ssn": SSN, "ip": IP, "phone": PHONE, "card": CARD}
# Every kind starts where no letter or digit stands before: most places fail at this first test.
ANY = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"

UPPER, LOWER, FIGURES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def code(key: str, *parts: Column) -> Column:
    """A keyed non-negative number below 2^60 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts).cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the pairs (left < left_size, right < right_size) as a struct (l, r).

    Rounds take turns: even ones add a keyed code of the right half to the left, modulo its size, odd ones
    the other way round. Each can be undone, so the whole is a permutation.
    """
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def turn(acc: Column, n: Column) -> Column:
        even = n % 2 == 0
        other, size = F.when(even, acc["r"]).otherwise(acc["l"]), F.when(even, left_size).otherwise(right_size)
        moved = F.pmod(F.when(even, acc["l"]).otherwise(acc["r"]) + F.pmod(code(key, tweak, n.cast("string"), other.cast("string")), size), size)
        return F.struct(F.when(even, moved).otherwise(acc["l"]).cast("bigint").alias("l"), F.when(even, acc["r"]).otherwise(moved).cast("bigint").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_digits(value: Column, key: str, tweak: str) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length; a single digit is shifted by a keyed amount."""
    n = F.length(value)
    cut_at = (n / 2).cast("int")
    left, right = F.substr(value, F.lit(1), cut_at), F.substr(value, cut_at + 1, n)
    a, b = F.pow(F.lit(10), cut_at).cast("bigint"), F.pow(F.lit(10), n - cut_at).cast("bigint")
    out = feistel(F.coalesce(F.nullif(left, F.lit("")).cast("bigint"), F.lit(0)), right.cast("bigint"), a, b, key, F.concat(F.lit(tweak), n.cast("string")))
    single = F.pmod(value.cast("bigint") + code(key, F.lit(tweak)), F.lit(10)).cast("string")
    both = F.transform(F.array(out), lambda p: F.concat(F.lpad(p["l"].cast("string"), cut_at, "0"), F.lpad(p["r"].cast("string"), n - cut_at, "0")))[0]
    return F.when(n <= 1, single).otherwise(both)


def refilled(value: Column, figures: Column) -> Column:
    """``value`` with its digits replaced, in order, by those of ``figures``; other characters stay."""
    chars = F.split(value, "")
    return F.aggregate(
        chars, F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["s"], F.substr(figures, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i"))),
        lambda acc: acc["s"],
    )


def luhn_sum(figures: Column, doubled: int) -> Column:
    """Luhn's sum, where the digits at places from the right of parity ``doubled`` count twice."""
    return F.aggregate(
        F.transform(F.split(F.reverse(figures), ""), lambda c, i: F.when(i % 2 == doubled, (c.cast("int") * 2) % 10 + (c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int"))),
        F.lit(0), lambda s, x: s + x,
    )


def mod97(text: Column) -> Column:
    """Remainder by 97 of the text's digits, letters counting 10 to 35."""
    return F.aggregate(
        F.split(text, ""), F.lit(0),
        lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97),
    )


def card(value: Column, key: str) -> Column:
    d = digits(value)
    body = permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    full = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string")))[0]
    return F.when(luhn_sum(d, 1) % 10 == 0, refilled(value, full)).otherwise(value)


def phone(value: Column, key: str) -> Column:
    d = digits(value)
    ten = F.substr(d, F.length(d) - 9, F.lit(10))
    # the area code stays; the exchange must again start with 2 to 9, so it is permuted as 0 to 799
    number = F.substr(ten, F.lit(4), F.lit(7)).cast("bigint") - 2_000_000
    area = F.substr(ten, F.lit(1), F.lit(3))
    out = feistel((number / 10_000).cast("bigint"), number % 10_000, F.lit(800), F.lit(10_000), key, F.concat(F.lit("phone"), area))
    seven = F.transform(F.array(out), lambda p: (p["l"] * 10_000 + p["r"] + 2_000_000).cast("string"))[0]
    full = F.concat(F.substr(d, F.lit(1), F.length(d) - 7), seven)
    return F.when(ten.rlike("^[2-9][0-9]{2}[2-9]"), refilled(value, full)).otherwise(value)


def ip(value: Column, key: str) -> Column:
    p = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    out = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65_536), F.lit(65_536), key, F.lit("ip"))
    text = F.transform(F.array(out), lambda o: F.concat_ws(".", (o["l"] / 256).cast("int"), (o["l"] % 256).cast("int"), (o["r"] / 256).cast("int"), (o["r"] % 256).cast("int")))[0]
    return F.when(F.forall(p, lambda x: x <= 255), text).otherwise(value)


def date(value: Column, key: str) -> Column:
    """Dates with slashes count as day first where that is a day, else as month first."""
    out = value
    for pattern, shape in (("yyyy-MM-dd", r"^[0-9]{4}-"), ("MM/dd/yyyy", "/"), ("dd/MM/yyyy", "/"), ("dd.MM.yyyy", r"\..*\.")):
        day = F.to_date(F.try_to_timestamp(value, F.lit(pattern)))
        n = F.datediff(day, F.lit(FIRST_DAY))
        fits = value.rlike(shape) & day.between(FIRST_DAY, LAST_DAY)
        moved = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted_day(n, key))
        out = F.when(fits, F.date_format(moved, pattern)).otherwise(out)
    return out


def permuted_day(n: Column, key: str) -> Column:
    """A day number permuted below ``DAYS``: the network works on 271 * 270 numbers and is applied again while beyond."""
    def once(x: Column) -> Column:
        return F.transform(F.array(feistel((x / 270).cast("bigint"), x % 270, F.lit(271), F.lit(270), key, F.lit("date"))), lambda p: p["l"] * 270 + p["r"])[0]

    # 73,049 days lie below 271 * 270 = 73,170: 121 numbers lie beyond; a walk through more than 121 of them cannot happen
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(121)), F.struct(n.cast("bigint").alias("x"), F.lit(False).alias("done")),
        lambda acc, i: F.when(acc["done"], acc).otherwise(
            F.transform(F.array(once(acc["x"])), lambda y: F.struct(y.alias("x"), (y < DAYS).alias("done")))[0]
        ),
        lambda acc: acc["x"],
    ).cast("int")


def ssn(value: Column, key: str) -> Column:
    valid = value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")
    return F.when(valid, refilled(value, permuted_digits(digits(value), key, "ssn"))).otherwise(value)


def iban(value: Column, key: str) -> Column:
    compact = F.regexp_replace(value, " ", "")
    body, country = F.substr(compact, F.lit(5), F.length(compact)), F.substr(compact, F.lit(1), F.lit(2))
    moved = refilled(body, permuted_digits(digits(body), key, "iban"))
    check = F.transform(F.array(moved), lambda m: F.lpad((98 - mod97(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0"))[0]
    whole = F.concat(check, digits(moved))
    valid = (mod97(F.concat(body, F.substr(compact, F.lit(1), F.lit(4)))) == 1) & (F.length(digits(body)) >= 2)
    return F.when(valid, refilled(value, whole)).otherwise(value)


def scrambled(value: Column, keep: Column, key: str, tweak: str) -> Column:
    """Letters and digits after the first ``keep`` characters, each replaced within its own class.

    The characters form a Feistel pair: a keyed code of one half of the string chooses the shift of every
    character of the other half, in turns, so that the whole is a permutation of the strings of that shape.
    """
    head, body = F.substr(value, F.lit(1), keep), F.substr(value, keep + 1, F.length(value))
    half = (F.length(body) / 2).cast("int")

    def shifted(text: Column, other: Column, n: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = code(key, F.lit(tweak), n.cast("string"), i.cast("string"), other)

            def within(alphabet: str) -> Column:
                size = len(alphabet)
                return F.substr(F.lit(alphabet), (F.pmod(F.instr(F.lit(alphabet), c) - 1 + by, F.lit(size)) + 1).cast("int"), F.lit(1))

            return F.when(c.rlike("[0-9]"), within(FIGURES)).when(c.rlike("[a-z]"), within(LOWER)).when(c.rlike("[A-Z]"), within(UPPER)).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")

    def turn(acc: Column, n: Column) -> Column:
        even = n % 2 == 0
        moved = shifted(F.when(even, acc["l"]).otherwise(acc["r"]), F.when(even, acc["r"]).otherwise(acc["l"]), n)
        return F.transform(F.array(moved), lambda m: F.struct(F.when(even, m).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(m).alias("r")))[0]

    start = F.struct(F.substr(body, F.lit(1), half).alias("l"), F.substr(body, half + 1, F.length(body)).alias("r"))
    return F.concat(head, F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, turn, lambda acc: F.concat(acc["l"], acc["r"])))


def email(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    return F.concat(scrambled(F.substr(value, F.lit(1), at - 1), F.lit(0), key, "email"), F.substr(value, at, F.length(value)))


def secret(value: Column, key: str) -> Column:
    """The name and the sign after it stay."""
    return scrambled(value, F.length(F.regexp_extract(value, r"^[A-Za-z_-]+[\"']?\s{0,3}[=:]\s{0,3}[\"']?", 0)), key, "secret")


def api_key(value: Column, key: str) -> Column:
    return scrambled(value, F.when(value.startswith("sk-"), 3).otherwise(4), key, "key")


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one matched string; the string itself where the checks of its kind fail."""
    out = value
    makers = {"card": card, "phone": phone, "ip": ip, "ssn": ssn, "date": date, "iban": iban, "key": api_key, "secret": secret, "email": email}
    for kind, make in makers.items():
        out = F.when(value.rlike(f"^(?:{KINDS[kind]})$"), make(value, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``column``; ``n_found`` counts the values replaced.

    All rows and other columns stay (one named ``n_found`` is replaced). NULL stays NULL with count 0; an
    empty text stays empty. Values that look like a kind but fail its check stay as they are. A projection:
    no shuffle, nothing held but the row itself.
    """
    text = F.col(column)
    # a text without one of these characters cannot match: its split is spared
    maybe = text.rlike("[0-9@=:_-]")
    matches = F.when(maybe, F.regexp_extract_all(column, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(maybe, F.split(text, ANY, -1)).otherwise(F.array(text))
    with_matches = docs.withColumns({"__m": matches, "__g": gaps})
    with_names = with_matches.withColumn("__p", F.transform("__m", lambda v: pseudonym(v, key)))
    woven = F.array_join(F.flatten(F.transform("__g", lambda g, i: F.array(g, F.coalesce(F.get(F.col("__p"), i), F.lit(""))))), "")
    changed = F.size(F.filter(F.arrays_zip("__m", "__p"), lambda z: z["__m"] != z["__p"])).cast("bigint")
    return with_names.withColumns({
        column: F.when(F.size("__m") > 0, woven).otherwise(text),
        "n_found": F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(changed),
    }).drop("__m", "__g", "__p")
