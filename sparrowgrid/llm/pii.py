r"""Format-preserving pseudonyms for personal numbers, dates and addresses, in Spark expressions only.

Candidates are found by one pattern; those that their kind's rule validates are replaced by a value of the same
format under a keyed permutation, so that equal values stay equal across documents and nothing else does:

* card numbers (13 to 19 digits, Luhn): all digits but the last are permuted, and the last is computed anew. Where other digits stand beside
  a number (a code, a date), the groups that have a card's form (:func:`_cards`) are tried one after the other;
* telephone numbers: international ones (8 to 15 digits) keep the country's code, which a list tells, whatever the separators; national ones
  are (ddd) ddd-dddd and ddd-ddd-dddd, and those with a leading 0;
* social security numbers (ddd-dd-dddd, of an area that exists): the nine digits are permuted until they are one again;
* IPv4 addresses (four numbers up to 255): the 32 bits are permuted;
* dates (ISO, or before the year day and month, or month and day where only that is a date): the day is permuted within its 131,072 days.

The permutation is a Feistel network over two halves (of digits or bits), whose rounds add a SHA-256 of the key, the
kind, the length, the round and the other half; it is a bijection of each format. E-mail addresses and hexadecimal
secrets have no fixed format to permute; their local part and digits are replaced by a keyed digest of equal form.

Values with fewer valid forms than their format has (telephone numbers, social security numbers, the first and the last days of the calendar) are
permuted again until the result is valid, which keeps the permutation one of the valid values.

Defined results: a null text stays null; an empty text, and one without a validated value, stays as it is; rows are
never merged or dropped; an empty table gives an empty result; further columns pass through, whatever their names: where one has the
name of the figure, the figure's gets underscores behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}|\([2-9]\d{2}\) ?[2-9]\d{2}-\d{4}|[2-9]\d{2}-[2-9]\d{2}-\d{4}|0[1-9]\d{1,3}[ /]\d{6,8})(?![\d-])"
CARD = r"(?<!\d)(?<!\d\.)\d(?:[ -]?\d){12,98}(?!\d)"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
#: In order of precedence where two could start at one place.
KINDS = (("email", EMAIL), ("secret", SECRET), ("ipv4", IPV4), ("date", DATE), ("ssn", SSN), ("phone", PHONE), ("card", CARD))
ANY = "|".join(p for _, p in KINDS)
FIRST_DAY, DAYS, LAST_YEAR = "1750-01-01", (256, 512), 9999
#: Repeated permutations, at most: a result that is still invalid then has a chance below 1e-12, and the value stays as it is.
WALK = 16
# Calling codes of one and of two digits; all others have three.
CODES_1 = ("1", "7")
CODES_2 = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(11)]), n + 1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str) -> Column:
    """A keyed permutation of pairs below (left_size, right_size): a struct of ``l`` and ``r``."""

    def add(own: Column, other: Column, size: Column, r: Column) -> Column:
        word = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), left_size.cast("string"), right_size.cast("string"), r.cast("string"), other.cast("string")), 256)
        return F.pmod(own + F.conv(F.substring(word, 1, 15), 16, 10).cast("long") % size, size)

    def step(pair: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, add(pair["l"], pair["r"], left_size, r)).otherwise(pair["l"]).alias("l"), F.when(even, pair["r"]).otherwise(add(pair["r"], pair["l"], right_size, r)).alias("r"))

    start = F.struct(F.coalesce(left.cast("long"), F.lit(0).cast("long")).alias("l"), F.coalesce(right.cast("long"), F.lit(0).cast("long")).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 20 digits as another of its length."""

    def halves(d: Column, a: Column, b: Column) -> Column:
        pair = let(F.struct(_power(a).alias("a"), _power(b).alias("b")), lambda size: feistel(F.substr(d, F.lit(1), a), F.substr(d, a + 1, b), size["a"], size["b"], key, kind))
        return let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), a, F.lit("0")), F.lpad(p["r"].cast("string"), b, F.lit("0"))))

    parts = lambda d: F.struct(d.alias("d"), (F.length(d) / 2).cast("int").alias("a"), (F.length(d) - (F.length(d) / 2).cast("int")).alias("b"))
    return let(digits, lambda d: let(parts(d), lambda x: halves(x["d"], x["a"], x["b"])))


def characters(text: Column) -> Column:
    """A string's characters."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum from the right; every second digit is doubled, the last too if ``doubled`` is 0."""
    each = F.transform(F.reverse(characters(digits)), lambda c, k: F.when(k % 2 == doubled, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def into_format(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order; null without digits."""
    return F.when(digits.isNotNull(), F.array_join(F.transform(characters(shape), lambda c, k: F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(shape, F.lit(1), k + 1))), F.lit(1))).otherwise(c)), ""))


def walked(start: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """``step`` repeated from ``start`` until ``valid``; null if that takes over WALK steps."""
    out = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), let(start, step), lambda x, _: F.when(valid(x), x).otherwise(step(x)))
    return let(out, lambda x: F.when(valid(x), x))


def _is_card(digits: Column) -> Column:
    return let(digits, lambda d: F.length(d).between(13, 19) & (luhn_sum(d, 1) % 10 == 0))


def _new_card(digits: Column, key: str) -> Column:
    body = let(digits, lambda d: permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"))
    return let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, 0) % 10, F.lit(10)).cast("string")))


def _cards(m: Column, key: str) -> Column:
    """A run's digits with its cards replaced, or null without one: the first groups, from the left, that are one group of 13 to 19 digits, four of
    four (with up to three more digits, if so it is one), or groups of 4, 6 and 4 or 5."""

    def replaced(groups: Column) -> Column:
        size = lambda k: F.coalesce(F.length(F.get(groups, k)), F.lit(0))

        def taken(k: Column) -> Column:
            fours = (size(k) == 4) & (size(k + 1) == 4) & (size(k + 2) == 4) & (size(k + 3) == 4)
            forms = ((1, size(k) >= 13), (5, fours & size(k + 4).between(1, 3)), (4, fours), (3, (size(k) == 4) & (size(k + 1) == 6) & size(k + 2).between(4, 5)))
            return F.coalesce(*[F.when(form & _is_card(F.array_join(F.slice(groups, k + 1, n), "")), n) for n, form in forms], F.lit(0))

        def fold(acc: Column, k: Column) -> Column:
            def one(n: Column) -> Column:
                own = F.when(n == 0, F.get(groups, k)).otherwise(_new_card(F.array_join(F.slice(groups, k + 1, n), ""), key))
                return F.struct((k + F.greatest(n, F.lit(1))).cast("int").alias("next"), F.concat(acc["digits"], own).alias("digits"), (acc["found"] | (n > 0)).alias("found"))

            return F.when(k < acc["next"], acc).otherwise(let(taken(k), one))

        start = F.struct(F.lit(0).alias("next"), F.lit("").alias("digits"), F.lit(False).alias("found"))
        return let(F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, fold), lambda out: F.when(out["found"], out["digits"]))

    return let(F.split(m, "[ -]"), replaced)


def _card(m: Column, key: str) -> Column:
    new = let(_digits(m), lambda d: F.when(_is_card(d), _new_card(d, key)).otherwise(_cards(m, key)))
    return let(new, lambda d: into_format(m, d))


def _phone(m: Column, key: str) -> Column:
    permute = lambda d: permuted_digits(d, key, "phone")

    def abroad(digits: Column) -> Column:
        country = F.when(F.substr(digits, F.lit(1), F.lit(1)).isin(*CODES_1), 1).when(F.substr(digits, F.lit(1), F.lit(2)).isin(*CODES_2), 2).otherwise(3)
        new = let(country, lambda c: F.concat(F.substr(digits, F.lit(1), c), permute(F.substr(digits, c + 1, F.length(digits) - c))))
        return F.when(F.length(digits).between(8, 15), new)

    zero = lambda digits: F.concat(F.lit("0"), walked(F.substr(digits, F.lit(2), F.length(digits) - 1), permute, lambda d: ~F.startswith(d, F.lit("0"))))
    plain = lambda digits: walked(digits, permute, lambda d: d.rlike("^[2-9]..[2-9]"))
    new = let(_digits(m), lambda d: F.when(F.startswith(m, F.lit("+")), abroad(d)).when(F.startswith(d, F.lit("0")), zero(d)).otherwise(plain(d)))
    return let(new, lambda d: into_format(m, d))


def _is_ssn(digits: Column) -> Column:
    return ~digits.rlike("^(000|666|9)|^...00|0000$")


def _ssn(m: Column, key: str) -> Column:
    new = let(_digits(m), lambda d: F.when(_is_ssn(d), walked(d, lambda x: permuted_digits(x, key, "ssn"), _is_ssn)))
    return let(new, lambda d: into_format(m, d))


def _ipv4(m: Column, key: str) -> Column:
    size = F.lit(65536).cast("long")

    def new(part: Column) -> Column:
        text = lambda p: F.concat_ws(".", *[x.cast("string") for half in (p["l"], p["r"]) for x in ((half / 256).cast("int"), half % 256)])
        return F.when(F.forall(part, lambda x: x < 256), let(feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], size, size, key, "ipv4"), text))

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), new)


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    base = F.lit(FIRST_DAY).cast("date")
    block = DAYS[0] * DAYS[1]
    a, b = (F.lit(x).cast("long") for x in DAYS)
    low, high = (F.datediff(F.lit(x).cast("date"), base) for x in ("0001-01-01", f"{LAST_YEAR}-12-31"))
    day = lambda n: F.date_add(base, n.cast("int"))
    two = lambda c: F.lpad(c.cast("string"), 2, F.lit("0"))

    def read(part: Column) -> Column:
        parsed = lambda *order: F.try_to_timestamp(F.concat_ws("-", *[part[k] for k in order]), F.lit("yyyy-MM-dd")).cast("date")
        first = F.when(iso, parsed(0, 1, 2)).otherwise(parsed(2, 1, 0))
        return let(first, lambda d: F.struct(F.datediff(F.when(~iso & d.isNull(), parsed(2, 0, 1)).otherwise(d), base).cast("long").alias("n"), (~iso & d.isNull()).alias("swapped")))

    def moved(x: Column) -> Column:
        start = F.floor(x["n"] / block) * block

        def step(n: Column) -> Column:
            return let(feistel(F.floor((n - start) / DAYS[1]), (n - start) % DAYS[1], a, b, key, "date"), lambda p: start + p["l"] * DAYS[1] + p["r"])

        # What was month first stays so, and no other date becomes one that is read in another order.
        new = walked(x["n"], step, lambda n: n.between(low, high) & (~x["swapped"] | (F.dayofmonth(day(n)) > 12)))
        return let(day(new), lambda d: written(d, x["swapped"]))

    def written(d: Column, swapped: Column) -> Column:
        year, month, own = F.lpad(F.year(d).cast("string"), 4, F.lit("0")), two(F.month(d)), two(F.dayofmonth(d))
        other = F.concat(F.when(swapped, month).otherwise(own), F.substring(m, 3, 1), F.when(swapped, own).otherwise(month), F.substring(m, 6, 1), year)
        return F.when(iso, F.concat(year, F.lit("-"), month, F.lit("-"), own)).otherwise(other)

    return let(F.split(m, "[./-]"), lambda part: let(read(part), lambda x: F.when(x["n"].isNotNull(), moved(x))))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256), 1, 12), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    word = F.substr(F.sha2(F.concat(F.lit(f"{key}|secret|"), m), 256), F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(word)).otherwise(word)


_MAKE = {"email": _email, "secret": _secret, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(match: Column, key: str) -> Column:
    """The replacement of a match, or null if its kind's rule doesn't validate it."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS):
        out = F.when(match.rlike(f"^(?:{pattern})$"), _MAKE[kind](match, key)).otherwise(out)
    return out


def replace_pii(docs: DataFrame, key: str, text: str = "text", count: str = "n_pii") -> DataFrame:
    """``docs`` with validated values replaced in ``text``, and their number in a further column, ``count``."""
    while count in docs.columns:
        count += "_"
    names = [f"c{k}" for k in range(len(docs.columns))]  # positions, whatever the columns' names
    own = F.col(names[docs.columns.index(text)])
    worth = own.rlike("[0-9@]|[0-9A-Fa-f]{32}")
    found = F.when(worth, F.regexp_extract_all(own, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    step = docs.toDF(*names).withColumn("found", found).withColumn("new", F.transform("found", lambda m: pseudonym(m, key)))
    gaps = F.split(own, ANY, -1)
    filled = F.concat(F.zip_with("found", "new", lambda m, p: F.coalesce(p, m)), F.array(F.lit("")))
    whole = F.array_join(F.flatten(F.zip_with(gaps, filled, lambda g, m: F.array(g, m))), "")
    changed = F.when(F.size("found") > 0, whole).otherwise(own)
    columns = [changed if c == text else F.col(n) for c, n in zip(docs.columns, names, strict=True)]
    return step.select(*columns, F.size(F.filter("new", lambda p: p.isNotNull())).cast("long")).toDF(*docs.columns, count)
