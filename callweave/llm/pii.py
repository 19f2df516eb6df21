"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations in plain column expressions.

A value is found by one pattern, validated, turned into a number of its format's domain, permuted by a Feistel network and
written back in the same format. The domain is a product of two moduli; each round adds a keyed hash of one half to the
other half, so a permutation maps the valid values of a format onto themselves: equal values stay equal wherever they stand,
different ones stay different. Without the key nobody can invert it. No Python runs on the rows.

| format | valid if | domain |
|---|---|---|
| card number, 13-19 digits, spaces or hyphens kept | check digit | all digits but the first and the check digit, which follows |
| North American telephone number | area and exchange from 200 | 800 x 800 x 10,000 |
| social security number | area, group and serial in use | digits of each group within their ranges |
| IPv4 address | four numbers up to 255 | 2^32 |
| date, year-month-day or day/month/year or month/day/year | a date of 1800-2199 | its 146,097 days |
| e-mail address | - | letters and digits before the @, each run within its alphabet |
| password, token or key | - | each run of letters and digits within its alphabet |

What looks like a format but is not valid stays as it is. Where digits stand in a row, separated by single spaces or hyphens,
each run of 13 to 19 of them made of whole groups is a candidate for a card number: at each place the longest valid one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "set a key of your own"  # the default serves tests; a job passes its own

# A card number begins where no digit stands before and, unless another number does, no hyphen; it ends before no digit.
CARD_START, CARD_END = r"(?<![0-9])(?<!(?<![0-9])-)", r"(?![0-9])"
# Patterns by kind, tried in this order at each place.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9]{12,})",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": CARD_START + "[0-9](?:[ -]?[0-9]){12,18}" + CARD_END,
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
}
CARD_LENGTHS = range(19, 12, -1)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())  # finds nothing in a text without values; which digits are a card's, any_value tells


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash(key: str, tag: Column, round_: Column, value: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), tag, round_.cast("string"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def permuted(x: Column, left: Column, right: Column, key: str, tag: Column) -> Column:
    """``x`` in 0 .. left * right - 1 under the permutation that key and tag name. Both moduli stay below 2^31."""
    def step(acc: Column, i: Column) -> Column:
        a, b = acc["a"], acc["b"]
        return F.when(i % 2 == 0, F.struct(F.pmod(a + _hash(key, tag, i, b, left), left).alias("a"), b.alias("b"))).otherwise(
            F.struct(a.alias("a"), F.pmod(b + _hash(key, tag, i, a, right), right).alias("b")))

    begin = F.struct(F.call_function("div", x, right).alias("a"), F.pmod(x, right).alias("b"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), begin, step, lambda acc: acc["a"] * right + acc["b"])


def _power(base: int, exponent: Column) -> Column:
    return F.element_at(F.array(*[F.lit(base**i).cast("long") for i in range(10)]), exponent + 1)


def digits_permuted(digits: Column, key: str, tag: Column) -> Column:
    """A string of 1 to 18 digits, as a string of as many digits."""
    n = F.length(digits)
    half = F.call_function("div", n, F.lit(2)).cast("int")
    return F.lpad(permuted(digits.cast("long"), _power(10, half), _power(10, n - half), key, F.concat(tag, n.cast("string"))).cast("string"), n, "0")


def _letters_permuted(run: Column, alphabet: str, key: str, tag: Column) -> Column:
    """A string of 1 to 12 signs of an alphabet of at most 36, as another one."""
    base = len(alphabet)
    n = F.length(run)
    half = F.call_function("div", n, F.lit(2)).cast("int")
    number = F.aggregate(F.split(run, ""), F.lit(0).cast("long"),
                         lambda acc, c: acc * F.lit(base) + F.instr(F.lit(alphabet), c) - 1)
    out = permuted(number, _power(base, half), _power(base, n - half), key, F.concat(tag, n.cast("string")))
    ahead = F.array(*[F.lit(base**i).cast("long") for i in range(12)])
    return let(out, lambda v: F.array_join(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.substring(
        F.lit(alphabet), (F.pmod(F.call_function("div", v, F.element_at(ahead, i)), F.lit(base)) + 1).cast("int"), F.lit(1))), ""))


LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUNS = r"[a-z]{1,12}|[A-Z]{1,12}|[0-9]{1,12}|[^A-Za-z0-9]+"


def _runs_permuted(value: Column, key: str, tag: Column) -> Column:
    """Every run of letters of one case or of digits within its alphabet; all else stays. A run's place is part of its tag."""
    def one(run: Column, i: Column) -> Column:
        own = F.concat(tag, i.cast("string"))
        return F.when(run.rlike("^[a-z]"), _letters_permuted(run, LOWER, key, own)).when(
            run.rlike("^[A-Z]"), _letters_permuted(run, UPPER, key, own)).when(
            run.rlike("^[0-9]"), digits_permuted(run, key, own)).otherwise(run)
    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(_RUNS), F.lit(0)), one), "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The weighted sum of the digits; ``doubled`` tells whether the last (0) or the one before it (1) counts double."""
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == doubled, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int"))), F.lit(0), lambda a, d: a + d)


def _laid_out(like: Column, digits: Column) -> Column:
    """``digits`` with the separators of ``like``, in one pass over its signs."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return let(digits, lambda own: F.aggregate(F.split(like, ""), start, lambda acc, c: F.when(c.between("0", "9"), F.struct(
        F.concat(acc["out"], F.substring(own, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(
        F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))), lambda acc: acc["out"]))


def card_numbers(text: Column) -> Column:
    """The different card numbers of ``text`` as written, longest first: all runs of whole groups of digits with a valid check digit.

    They may overlap: a card's neighbours can be other numbers, so every place and every length is looked at.
    """
    found = [F.regexp_extract_all(text, F.lit(f"{CARD_START}(?=([0-9](?:[ -]?[0-9]){{{n - 1}}}){CARD_END})[0-9]"), F.lit(1)) for n in CARD_LENGTHS]
    return F.filter(F.array_distinct(F.concat(*found)), lambda v: F.pmod(luhn_sum(F.regexp_replace(v, "[ -]", ""), 1), F.lit(10)) == 0)


def any_value(text: Column) -> Column:
    """The pattern of all values of ``text``. Of card numbers it names the valid ones of this text only, so that others take no digits."""
    def one_of(cards: Column) -> Column:
        return F.when(F.size(cards) > 0, F.concat(F.lit(f"{CARD_START}(?:"), F.array_join(cards, "|"), F.lit(f"){CARD_END}"))).otherwise(F.lit("(?!)"))

    some = text.rlike("[0-9](?:[ -]?[0-9]){12}")
    parts = [F.when(some, let(card_numbers(text), one_of)).otherwise(F.lit("(?!)")) if kind == "card" else F.lit(p) for kind, p in PATTERNS.items()]
    return F.concat(F.lit("(?:"), F.concat_ws(")|(?:", *parts), F.lit(")"))


def _card(value: Column, key: str) -> Column:
    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(F.lit(10) - F.pmod(luhn_sum(body, 0), F.lit(10)), F.lit(10)).cast("string"))

    def card(digits: Column) -> Column:
        middle = F.substring(digits, F.lit(2), F.length(digits) - 2)
        body = F.concat(F.substring(digits, 1, 1), digits_permuted(middle, key, F.lit("card")))
        return F.when(F.pmod(luhn_sum(digits, 1), F.lit(10)) == 0, _laid_out(value, let(body, checked))).otherwise(value)

    return let(F.regexp_replace(value, "[ -]", ""), card)


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def _phone(value: Column, key: str) -> Column:
    def phone(digits: Column) -> Column:
        own = F.substring(digits, -10, 10)
        number = lambda at, n: F.substring(own, at, n).cast("long")
        index = ((number(1, 3) - 200) * 800 + number(4, 3) - 200) * 10000 + number(7, 4)
        country = F.when(F.length(digits) == 11, F.lit("1")).otherwise(F.lit(""))
        return let(permuted(index, F.lit(80000).cast("long"), F.lit(80000).cast("long"), key, F.lit("phone")), lambda out: _laid_out(value, F.concat(
            country, (_div(out, 8_000_000) + 200).cast("string"), (F.pmod(_div(out, 10000), F.lit(800)) + 200).cast("string"),
            F.lpad(F.pmod(out, F.lit(10000)).cast("string"), 4, "0"))))

    return let(F.regexp_replace(value, "[^0-9]", ""), phone)


def _ssn(value: Column, key: str) -> Column:
    """Areas 001-899 but 666 (898 of them), groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substring(value, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def text(out: Column) -> Column:
        new = _div(out, 99 * 9999) + 1
        return F.concat_ws("-", F.lpad((new + F.when(new >= 666, 1).otherwise(0)).cast("string"), 3, "0"),
                           F.lpad((F.pmod(_div(out, 9999), F.lit(99)) + 1).cast("string"), 2, "0"),
                           F.lpad((F.pmod(out, F.lit(9999)) + 1).cast("string"), 4, "0"))

    return F.when(valid, let(permuted(index, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, F.lit("ssn")), text)).otherwise(value)


def _ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))
    index = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p)
    weights = F.array(*[F.lit(256**i).cast("long") for i in (3, 2, 1, 0)])
    half = F.lit(65536).cast("long")
    octets = let(permuted(index, half, half, key, F.lit("ip")), lambda out: F.array_join(
        F.transform(weights, lambda w: F.pmod(F.call_function("div", out, w), F.lit(256)).cast("string")), "."))
    return F.when(F.forall(parts, lambda p: p <= 255), octets).otherwise(value)


def _date(value: Column, key: str) -> Column:
    """Day and month of the form with slashes: day first if the first number can only be a day, else month first."""
    form = F.when(value.contains("-"), "yyyy-MM-dd").when(F.substring(value, 1, 2).cast("int") > 12, "dd/MM/yyyy").otherwise("MM/dd/yyyy")

    def moved(index: Column) -> Column:
        new = F.date_add(F.lit("1800-01-01").cast("date"), permuted(index, F.lit(189).cast("long"), F.lit(773).cast("long"), key, F.lit("date")).cast("int"))
        return F.when(index.between(0, 146096), F.call_function("date_format", new, form)).otherwise(value)

    day = F.call_function("try_to_timestamp", value, form).cast("date")
    return let(F.datediff(day, F.lit("1800-01-01").cast("date")).cast("long"), moved)


def _email(value: Column, key: str) -> Column:
    return F.concat(_runs_permuted(F.substring_index(value, "@", 1), key, F.lit("email")), F.lit("@"), F.substring_index(value, "@", -1))


def _secret(value: Column, key: str) -> Column:
    head = F.regexp_extract(value, r"^(AKIA|[A-Za-z_]+\s*[=:]\s*\"?)", 1)
    return F.concat(head, _runs_permuted(F.substring(value, F.length(head) + 1, F.length(value)), key, F.lit("secret")))


KINDS: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of one value that :func:`any_value` has found. The first kind whose pattern fits all of it decides."""
    out = value
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), KINDS[kind](value, key)).otherwise(out)
    return out


def pseudonymised(text: Column, key: str = KEY) -> Column:
    """``text`` with a pseudonym in the place of every valid value. Null stays null."""
    def replaced(pattern: Column) -> Column:
        values = F.regexp_extract_all(text, pattern, F.lit(0))
        parts = F.zip_with(F.split(text, pattern, -1), F.transform(values, lambda v: pseudonym(v, key)),
                           lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
        return F.array_join(parts, "")

    return F.when(text.rlike("[0-9@]|AKIA|(?i:password|passwd|token|secret|api_key)"), let(any_value(text), replaced)).otherwise(text)


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with pseudonyms in the text column; all other columns, rows without text and repeated rows stay as they are."""
    return docs.withColumn(text_col, pseudonymised(F.col(f"`{text_col}`"), key))
