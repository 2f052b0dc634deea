"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations, in DataFrame functions only.

A value is found by a pattern and validated (Luhn sum, calendar, ranges), then permuted within its own format by a Feistel network whose rounds are keyed SHA-256 sums. The permutation depends on key, kind and format alone, so equal values stay equal in all documents, and no two values of a format share a pseudonym.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

ROUNDS = 8
#: Kinds in order: where patterns could match at one place, the first wins.
EMAIL, CARD, PHONE, IP, DATE, SSN, IBAN = "email", "card", "phone", "ip", "date", "ssn", "iban"
KINDS = (EMAIL, CARD, PHONE, IP, DATE, SSN, IBAN)
PATTERNS = {
    EMAIL: r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,24}",
    DATE: r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    IP: r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    SSN: r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    IBAN: r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    # Fixed groupings, so that no match runs into a neighbouring number.
    CARD: r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![0-9A-Za-z])",
    PHONE: r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?(?![0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4})[0-9]{2,4}){3,5}(?![0-9A-Za-z])",
}
ORDER = (EMAIL, DATE, IP, SSN, IBAN, CARD, PHONE)
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in ORDER)
#: A text without a match of this has no value at all.
HINT = "[0-9@]"
FIRST_DAY = "1900-01-01"
#: Blocks of days since FIRST_DAY, each permuted within itself: (first day, days of a block as a product). Whole blocks run from 100 to 9894; what is left of the years 1 to 9999 makes a block at either end.
DOMAIN_DAYS, YEARS, YEAR_DAYS = 73000, 200, 365
EARLY, LATE = (-693595, 65, 563), (2920000, 64, 601)
#: What the key begins with in plans; Spark's redaction blots it out of plans and event logs.
KEY_MARK = "pii-key-"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def classes(text: Column) -> Column:
    """The format of a value: a for small letters, A for capitals, 0 for digits, other characters as they are."""
    return F.translate(text, LOWER + UPPER + DIGITS, "a" * 26 + "A" * 26 + "0" * 10)


def stream(key: str, salt: Column, size: Column) -> Column:
    """`size` numbers below 2**16 (at most), from SHA-256 sums of key, salt and a counter."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / 16).cast("int")), lambda i: F.sha2(F.concat_ws("|", F.lit(key), salt, i.cast("string")).cast("binary"), 256))
    digits = F.array_join(blocks, "")
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))


def shift(text: Column, by: Column) -> Column:
    """Each letter or digit moved within its alphabet by the number at its place."""

    def moved(c: Column, n: Column) -> Column:
        def within(first: int, size: int) -> Column:
            return F.char(F.pmod(F.ascii(c) - first + n, F.lit(size)) + first)

        return F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, 26)).when(c.between("A", "Z"), within(65, 26)).otherwise(c)

    return F.array_join(F.zip_with(F.split(text, ""), by, moved), "")


def feistel(text: Column, key: str, kind: str) -> Column:
    """A permutation of all strings with the format of text (ASCII letters and digits permuted, the rest stays).

    Halves take turns: one is shifted by a keyed stream of the other. A single character is shifted by the key alone.
    """
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    form = classes(text)

    def turn(s: Column, i: Column) -> Column:
        def salted(other: Column) -> Column:
            return F.concat_ws("|", F.lit(kind), i.cast("string"), form, other)

        left = F.when((i % 2 == 0) & (F.length(s["l"]) > 0), shift(s["l"], stream(key, salted(s["r"]), F.length(s["l"])))).otherwise(s["l"])
        right = F.when(i % 2 == 1, shift(s["r"], stream(key, salted(s["l"]), F.length(s["r"])))).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last of which is not doubled."""
    at = F.split(F.reverse(digits), "")

    def worth(c: Column, i: Column) -> Column:
        d = c.try_cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(at, worth), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def with_luhn(body: Column) -> Column:
    """body and the digit that makes its Luhn sum a multiple of ten."""
    return F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))


def refill(form: Column, digits: Column) -> Column:
    """digits put in place of the digits of form."""
    at = F.split(form, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("n"))

    def step(s: Column, c: Column) -> Column:
        number = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(number, F.substring(digits, s["n"], F.lit(1))).otherwise(c)).alias("out"), F.when(number, s["n"] + 1).otherwise(s["n"]).alias("n"))

    return F.aggregate(at, start, step, lambda s: s["out"])


def mixed(left: Column, right: Column, n_left: int, n_right: int, key: str, kind: str) -> Column:
    """A permutation of pairs of integers below n_left and n_right, as a struct (l, r): Feistel halves of unlike sizes take turns."""
    start = F.struct(left.cast("int").alias("l"), right.cast("int").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        def by(other: Column) -> Column:
            salt = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string"))
            return F.conv(F.substring(F.sha2(salt.cast("binary"), 256), 1, 7), 16, 10).cast("int")

        l = F.when(i % 2 == 0, F.pmod(s["l"] + by(s["r"]), F.lit(n_left))).otherwise(s["l"])
        r = F.when(i % 2 == 1, F.pmod(s["r"] + by(s["l"]), F.lit(n_right))).otherwise(s["r"])
        return F.struct(l.alias("l"), r.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_day(day: Column, key: str) -> Column:
    """A permutation of the days of the years 1 to 9999, block by block."""

    def within(at: Column, left: int, right: int, kind: str) -> Column:
        pair = mixed(F.floor(at / right), at % right, left, right, key, kind)
        return pair["l"] * right + pair["r"]

    block = F.floor(day / DOMAIN_DAYS).cast("int") * DOMAIN_DAYS
    early, late = (within(day - first, left, right, f"{DATE}{first}") + first for first, left, right in (EARLY, LATE))
    return F.when(day < EARLY[0] + EARLY[1] * EARLY[2], early).when(day >= LATE[0], late).otherwise(block + within(F.pmod(day, F.lit(DOMAIN_DAYS)), YEARS, YEAR_DAYS, DATE))


def ssn_pseudonym(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99 and serials 0001 to 9999, permuted."""
    area, group, serial = (F.substring(value, at, n).try_cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    pair = mixed(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, SSN)
    new = pair["l"] + 1 + (pair["l"] >= 665).cast("int")
    return F.format_string("%03d-%02d-%04d", new, F.floor(pair["r"] / 9999).cast("int") + 1, pair["r"] % 9999 + 1)


def parsed_date(value: Column) -> Column:
    """The date of a value in one of the three formats, null if there is no such day. Slashes: month first."""
    iso = F.when(value.rlike("^[0-9]{4}-"), value).when(value.contains("/"), F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 1, 2), F.substring(value, 4, 2)))
    iso = iso.otherwise(F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)))
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")


def kind_of(value: Column) -> Column:
    """The kind of a match whose validation holds, else null."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    full = {k: value.rlike(f"^(?:{PATTERNS[k]})$") for k in ORDER}
    valid = {
        EMAIL: F.lit(True),
        DATE: parsed_date(value).isNotNull(),
        IP: F.forall(F.split(value, r"\."), lambda x: x.try_cast("int") <= 255),
        SSN: ~value.rlike("^(000|666|9)|-00-|-0000$"),
        IBAN: iban_valid(value),
        CARD: ((luhn_sum(digits) % 10 == 0) | leads_with_card(value)) & digits.rlike("[1-9]"),
        PHONE: F.length(digits) >= 7,
    }
    out = F.when(full[EMAIL], F.lit(EMAIL))
    for k in ORDER[1:]:
        out = out.when(full[k] & valid[k], F.lit(k))
    return out


def leads_with_card(value: Column) -> Column:
    """Do the first 16 of 19 grouped digits make a card number, while all 19 make none? The last three are its check value then."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return value.rlike("^[0-9]{4}([ -][0-9]{4}){3}[ -][0-9]{3}$") & (luhn_sum(digits) % 10 != 0) & (luhn_sum(F.substring(digits, 1, 16)) % 10 == 0)


def card_pseudonym(value: Column, key: str) -> Column:
    """The body permuted, the check digit made anew, groups as they are."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return refill(value, with_luhn(feistel(F.substring(digits, F.lit(1), F.length(digits) - 1), key, CARD)))


def iban_valid(value: Column) -> Column:
    """The ISO 7064 check of an IBAN: 97 leaves 1."""
    plain = F.regexp_replace(value, " ", "")
    return iban_sum(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1


def iban_sum(turned: Column) -> Column:
    """Digits and capitals (as 10 to 35) read as one number, modulo 97."""
    numbers = F.transform(F.split(turned, ""), lambda c: F.when(c.between("0", "9"), c).when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(F.lit("")))
    return F.aggregate(F.split(F.array_join(numbers, ""), ""), F.lit(0), lambda a, c: (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)


def iban_pseudonym(value: Column, key: str) -> Column:
    """Country and format stay, the account is permuted, the check digits are made anew."""
    account = feistel(F.substring(value, F.lit(5), F.length(value)), key, IBAN)
    country = F.substring(value, 1, 2)
    check = 98 - iban_sum(F.concat(F.regexp_replace(account, " ", ""), country, F.lit("00")))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of a kind; a value without a kind stays."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    lead = F.when(leads_with_card(value), 19).otherwise(F.length(value))  # 16 digits and three signs between them
    card = F.concat(card_pseudonym(F.substring(value, F.lit(1), lead), key), F.substring(value, lead + 1, F.length(value)))
    local = F.substring_index(value, "@", 1)
    email = F.concat(feistel(local, key, EMAIL), F.lit("@"), F.substring_index(value, "@", -1))
    day = permuted_day(F.datediff(parsed_date(value), F.lit(FIRST_DAY).cast("date")), key)
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), day)
    date = F.date_format(new, "yyyy-MM-dd")
    date = F.when(value.rlike("^[0-9]{4}-"), date).when(value.contains("/"), F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))
    number = feistel(digits, key, PHONE)
    return (
        F.when(kind == EMAIL, email).when(kind == CARD, card).when(kind == PHONE, refill(value, number))
        .when(kind == IP, ip_pseudonym(value, key)).when(kind == DATE, date).when(kind == SSN, ssn_pseudonym(value, key))
        .when(kind == IBAN, iban_pseudonym(value, key)).otherwise(value)
    )


def ip_pseudonym(value: Column, key: str) -> Column:
    """Four numbers up to 255, permuted as two halves of 16 bits."""
    at = F.transform(F.split(value, r"\."), lambda x: x.try_cast("int"))
    pair = mixed(at[0] * 256 + at[1], at[2] * 256 + at[3], 65536, 65536, key, IP)
    part = [F.floor(pair[h] / 256).cast("string") if k == 0 else (pair[h] % 256).cast("string") for h in ("l", "r") for k in (0, 1)]
    return F.concat_ws(".", *part)


def number_of(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind))


def hidden_key(docs: DataFrame, key: str) -> str:
    """A key derived from the caller's, marked so that Spark's redaction (set here unless the session has its own) keeps it out of plans and event logs."""
    conf = docs.sparkSession.conf
    if not conf.get("spark.sql.redaction.string.regex", None):
        conf.set("spark.sql.redaction.string.regex", KEY_MARK + "[0-9a-f]+")
    return KEY_MARK + hashlib.sha256(key.encode()).hexdigest()


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per row of docs: doc_id, text with pseudonyms, n_pii, n_<kind> for each kind, pii (values found: kind, pseudonym in order).

    Null texts count as empty and come back empty; a text without a valid value comes back as it is. Invalid look-alikes (a failed Luhn sum, the 31st of February) stay. Dates are read month first with slashes and day first with dots. Of 19 grouped digits that fail the Luhn sum while their first 16 pass, the 16 are a card. Repeated rows and ids are treated alike; a null id stays null. Other columns are not looked at. Empty input: empty output.
    """
    key = hidden_key(docs, key)
    d = documents(docs).withColumn("found", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>")))
    kinds = F.transform("found", lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    d = d.withColumn("typed", F.when(F.size("found") > 0, kinds).otherwise(F.array().cast("array<struct<value:string,kind:string>>")))
    d = d.withColumn("new", F.transform("typed", lambda s: F.struct(s["kind"].alias("kind"), pseudonym(s["value"], s["kind"], key).alias("value"))))
    gaps = F.split("text", ANY, -1)
    joined = F.array_join(F.zip_with(gaps, F.col("new.value"), lambda gap, v: F.concat(gap, F.coalesce(v, F.lit("")))), "")
    d = d.select("doc_id", F.when(F.size("new") > 0, joined).otherwise(F.col("text")).alias("text"), F.filter("new", lambda s: s["kind"].isNotNull()).alias("pii"))
    counts = [number_of(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), *counts, "pii")
