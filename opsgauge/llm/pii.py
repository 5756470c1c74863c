"""Personal data, replaced by format-preserving pseudonyms.

Card numbers, account numbers, phone numbers, social security numbers, addresses of
machines and people, and dates are validated and then permuted by a keyed Feistel
network inside their own format: a valid card number becomes another valid one, a
date another date.  Equal values get equal pseudonyms in every document and different
ones stay different.  Everything is built from SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgauge.llm.shared import col, fresh

KINDS = ["email", "iban", "phone", "card", "ssn", "date", "ip"]
ROUNDS = 8

# What may be personal data; each match is validated before it is replaced.
_EDGE = r"(?<![A-Za-z0-9])"
_END = r"(?![A-Za-z0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": _EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "phone": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])"
    r"|(?<![A-Za-z0-9+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
    r"|(?<![A-Za-z0-9+.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9.-]*[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9./])[0-9]{2}([./])[0-9]{2}\4(?:19|20)[0-9]{2}(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
}
# Every place where an account number may start, with the longest text that looks like one.
IBAN_STARTS = _EDGE + "(?=(" + PATTERNS["iban"] + "))"
# Lengths by country, of the IBAN registry; elsewhere any length.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
# The days of the 200 years from here on are 17 x 4297.
FIRST_DAY, DAY_ROWS, DAY_COLUMNS = "1900-01-01", 17, 4297


def _once(value: Column, function) -> Column:
    """``function`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _noise(key: str, turn: int, value: Column) -> Column:
    """A keyed pseudo-random number of 60 bits."""
    text = F.concat_ws("|", F.lit(key), F.lit(turn), value)
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def _shift(turn: int, key: str, tweaked, rows: Column, columns: Column):
    """One Feistel round on a pair: by turns, a moves by a function of b and b by one of a."""
    if turn % 2 == 0:
        return lambda p: F.struct(F.pmod(p["a"] + _noise(key, turn, tweaked(p["b"])), rows).alias("a"), p["b"].alias("b"))
    return lambda p: F.struct(p["a"].alias("a"), F.pmod(p["b"] + _noise(key, turn, tweaked(p["a"])), columns).alias("b"))


def feistel(value: Column, rows: int | Column, columns: int | Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the numbers below ``rows`` x ``columns``.

    The number is a place in a table; in turn its row is shifted by a function of its column and its
    column by a function of its row, each of which can be undone.
    """
    high = F.lit(rows).cast("bigint") if isinstance(rows, int) else rows
    wide = F.lit(columns).cast("bigint") if isinstance(columns, int) else columns
    value = value.cast("bigint")
    pair = F.struct(_div(value, wide).cast("bigint").alias("a"), F.pmod(value, wide).alias("b"))
    for turn in range(ROUNDS):
        pair = _once(pair, _shift(turn, key, lambda x: F.concat_ws("/", F.lit(tweak), x), high, wide))
    return _once(pair, lambda p: p["a"] * wide + p["b"])


def _div(a: Column, b: Column) -> Column:
    return (a - F.pmod(a, b)) / b


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the digit strings of the same length (1 to 36 digits)."""

    def power(length: Column) -> Column:
        return F.concat(F.lit("1"), F.repeat(F.lit("0"), length)).cast("bigint")

    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    pair = F.struct(
        F.coalesce(F.nullif(F.substring(digits, F.lit(1), half), F.lit("")).cast("bigint"), F.lit(0).cast("bigint")).alias("a"),
        F.substring(digits, half + 1, rest).cast("bigint").alias("b"),
    )
    own = F.concat(F.lit(tweak), F.length(digits).cast("string"))
    for turn in range(ROUNDS):
        pair = _once(pair, _shift(turn, key, lambda x: F.concat_ws("/", own, x), power(half), power(rest)))

    def written_out(p: Column) -> Column:
        first = F.when(half > 0, F.lpad(p["a"].cast("string"), half, "0")).otherwise("")
        return F.concat(first, F.lpad(p["b"].cast("string"), rest, "0"))

    return _once(pair, written_out)


def _refilled(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced by ``digits``, one by one."""
    before = lambda at: F.length(_digits(F.substring(text, F.lit(1), at)))
    parts = F.transform(
        F.split(text, ""), lambda c, at: F.when(c.rlike("[0-9]"), F.substring(digits, before(at) + 1, F.lit(1))).otherwise(c)
    )
    return F.array_join(parts, "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; every second digit from the right counts double, from the ``doubled``-th on."""
    parts = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, at: F.when(
            at % 2 == doubled, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))
        ).otherwise(c.cast("int")),
    )
    return F.aggregate(parts, F.lit(0), lambda total, x: total + x)


def _card(text: Column, key: str) -> Column:
    """All digits but the last are permuted; the last one makes the number valid again."""

    def changed(digits: Column) -> Column:
        body = _permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        return _once(body, lambda b: F.concat(b, F.pmod(-_luhn_sum(b, 0), F.lit(10)).cast("string")))

    def if_valid(digits: Column) -> Column:
        valid = F.pmod(_luhn_sum(digits, 1), F.lit(10)) == 0
        return F.when(valid, _once(changed(digits), lambda new: _refilled(text, new)))

    return _once(_digits(text), if_valid)


def _phone(text: Column, key: str) -> Column:
    """The country code stays."""
    code = F.regexp_extract(text, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(text, F.length(code) + 1, F.length(text))
    return F.concat(code, _refilled(rest, _permuted_digits(_digits(rest), key, "phone")))


def _ssn(text: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substring(text, at, size).cast("int") for at, size in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    order = area - 1 - (area > 666).cast("int")
    number = (order * 99 + group - 1).cast("bigint") * 9999 + serial - 1

    def written_out(n: Column) -> Column:
        upper = _div(n, F.lit(9999)).cast("bigint")
        new = _div(upper, F.lit(99)).cast("int") + 1
        new = new + (new >= 666).cast("int")
        return F.concat_ws(
            "-",
            F.lpad(new.cast("string"), 3, "0"),
            F.lpad((F.pmod(upper, F.lit(99)) + 1).cast("string"), 2, "0"),
            F.lpad((F.pmod(n, F.lit(9999)) + 1).cast("string"), 4, "0"),
        )

    return F.when(valid, _once(feistel(number, 898 * 99, 9999, key, "ssn"), written_out))


def _date(text: Column, key: str) -> Column:
    """Any day of 1900 to 2099, in the same notation."""
    dotted = ~text.contains("-")
    mark = F.substring(text, 3, 1)
    iso = F.when(
        dotted, F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2))
    ).otherwise(text)
    day = F.try_to_date(iso, "yyyy-MM-dd")
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(number, DAY_ROWS, DAY_COLUMNS, key, "date").cast("int"))
    shown = _once(
        new.cast("string"),
        lambda d: F.when(dotted, F.concat(F.substring(d, 9, 2), mark, F.substring(d, 6, 2), mark, F.substring(d, 1, 4))).otherwise(d),
    )
    return F.when(day.isNotNull(), shown)


def _ip(text: Column, key: str) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda x: x.cast("int"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, x: total * 256 + x)
    new = feistel(number, 1 << 16, 1 << 16, key, "ip")
    shown = _once(
        new, lambda n: F.concat_ws(".", *[F.shiftright(n, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)])
    )
    return F.when(F.forall(parts, lambda x: x < 256), shown)


def _shifted(text: Column, by: Column, key: str, turn: int) -> Column:
    """Letters and digits of ``text`` moved within their own kind, by a function of ``by`` and their place."""

    def moved(c: Column, at: Column) -> Column:
        step = _noise(key, turn, F.concat_ws("/", F.lit("email"), by, at))
        code = F.ascii(c)

        def ring(first: int, size: int) -> Column:
            return F.char(F.pmod(code - first + step, F.lit(size)) + first)

        digit = F.when(c.rlike("[0-9]"), ring(48, 10))
        return digit.when(c.rlike("[A-Z]"), ring(65, 26)).when(c.rlike("[a-z]"), ring(97, 26)).otherwise(c)

    return F.when(text == "", "").otherwise(F.array_join(F.transform(F.split(text, ""), moved), ""))


def _email(text: Column, key: str) -> Column:
    """The part before the at sign is permuted among those of the same shape; the host stays."""
    local, host = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    half = F.floor(F.length(local) / 2).cast("int")
    pair = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, F.length(local)).alias("b"))

    def moved(turn: int):
        if turn % 2 == 0:
            return lambda p: F.struct(p["a"].alias("a"), _shifted(p["b"], p["a"], key, turn).alias("b"))
        return lambda p: F.struct(_shifted(p["a"], p["b"], key, turn).alias("a"), p["b"].alias("b"))

    for turn in range(4):
        pair = _once(pair, moved(turn))
    return _once(pair, lambda p: F.concat(p["a"], p["b"], F.lit("@"), host))


def _iban_rest(text: Column) -> Column:
    """The number modulo 97 with letters as 10 to 35, from the left."""
    digits = F.transform(
        F.split(text, ""),
        lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55),
    )
    return F.aggregate(digits, F.lit(0), lambda rest, x: (rest * F.when(x > 9, 100).otherwise(10) + x) % 97)


def _iban(text: Column, key: str) -> Column:
    """The digits of the account are permuted, the check digits made to fit; letters stay."""

    def changed(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        new = _refilled(account, _permuted_digits(_digits(account), key, "iban"))
        return _once(
            new,
            lambda n: F.concat(
                F.lpad((98 - _iban_rest(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0"), _digits(n)
            ),
        )

    plain = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(_is_iban(plain), _once(changed(plain), lambda digits: _refilled(text, digits)))


def _is_iban(plain: Column) -> Column:
    """Whether a number without blanks has its country's length, a digit in the account and fitting check digits."""
    account = F.substring(plain, F.lit(5), F.length(plain))
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    length = F.coalesce(F.try_element_at(lengths, F.substring(plain, 1, 2)), F.length(plain))
    fits = (F.length(plain) == length) & (F.length(_digits(account)) > 0)
    return F.when(fits, _iban_rest(F.concat(account, F.substring(plain, 1, 4))) == 1).otherwise(F.lit(False))


def _ibans(text: Column) -> Column:
    """The account numbers of a text, as written, longest first.

    What follows a number can look like more of it, so of each start the longest part up to a blank
    that is valid is taken.
    """

    def longest(found: Column) -> Column:
        words = F.split(found, " ")
        parts = F.transform(
            F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")
        )
        # As long as the pattern asks for.
        return F.get(
            F.filter(parts, lambda x: (F.length(F.replace(x, F.lit(" "), F.lit(""))) >= 12) & _is_iban(F.replace(x, F.lit(" "), F.lit("")))),
            F.lit(0),
        )

    starts = F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(IBAN_STARTS), F.lit(1)), F.array().cast("array<string>")))
    found = F.array_distinct(F.filter(F.transform(starts, longest), lambda x: x.isNotNull()))
    return F.array_sort(found, lambda a, b: F.length(b) - F.length(a))


def _any(ibans: Column) -> Column:
    """The pattern of all kinds for a text that holds ``ibans``: no other text is taken for an account number."""
    at = KINDS.index("iban")
    before, after = ("|".join(PATTERNS[kind] for kind in kinds) for kinds in (KINDS[:at], KINDS[at + 1 :]))
    own = F.concat(F.lit(f"{before}|{_EDGE}(?=[A-Z]{{2}}[0-9]{{2}})(?:"), F.array_join(ibans, "|"), F.lit(f"){_END}|{after}"))
    return F.when(F.size(ibans) > 0, own).otherwise(F.lit(f"{before}|{after}"))


def _pseudonym(found: Column, key: str) -> Column:
    """``kind, text`` of a match; NULL if it is not valid."""
    makers = {"email": _email, "iban": _iban, "phone": _phone, "card": _card, "ssn": _ssn, "date": _date, "ip": _ip}
    result = F.lit(None).cast("struct<kind:string,text:string>")
    for kind in reversed(KINDS):
        whole = found.rlike("^(?:" + _alone(PATTERNS[kind]) + ")$")
        made = F.struct(F.lit(kind).alias("kind"), makers[kind](found, key).alias("text"))
        result = F.when(whole, made).otherwise(result)
    return result


def _alone(pattern: str) -> str:
    """A pattern by itself: its groups are numbered from 1."""
    for number in (2, 4):
        pattern = pattern.replace(f"\\{number}", "\\1")
    return pattern.replace("\\3", "\\2")


def pseudonymized(docs: DataFrame, key: str, text_column: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with personal data in the text replaced, and a column ``name`` of ``kind, n`` counts.

    ``key`` is secret: with the same key, equal values get equal pseudonyms in all documents and runs.
    What only looks like personal data (a card number that fails its check digit, the 31st of
    June, an address above 255, an account number without its country's length) stays as it is.  NULL stays NULL and empty stays empty, without counts.  Other
    columns are kept, an existing column ``name`` is replaced.  No rows: no rows.
    """
    ibans, pattern, matches, gaps, made = fresh(docs.columns, "ibans", "pattern", "matches", "gaps", "made")
    text = col(text_column)
    step = docs.withColumn(ibans, _ibans(text))
    step = step.withColumn(pattern, _any(F.col(ibans)))
    step = step.withColumn(matches, F.coalesce(F.regexp_extract_all(text, F.col(pattern), F.lit(0)), F.array().cast("array<string>")))
    step = step.withColumn(made, F.transform(matches, lambda m: _pseudonym(m, key)))
    # The text between the matches; most texts have none and are not cut.
    step = step.withColumn(gaps, F.when(F.size(matches) > 0, F.split(text, F.col(pattern))))
    new = F.transform(
        gaps,
        lambda gap, at: F.concat(gap, F.coalesce(F.get(F.col(made), at)["text"], F.get(F.col(matches), at), F.lit(""))),
    )
    counts = F.transform(
        F.array(*[F.lit(kind) for kind in KINDS]),
        lambda kind: F.struct(
            kind.alias("kind"),
            F.size(F.filter(made, lambda m: (m["kind"] == kind) & m["text"].isNotNull())).cast("bigint").alias("n"),
        ),
    )
    return step.withColumns({text_column: F.when(F.size(matches) > 0, F.array_join(new, "")).otherwise(text), name: counts}).drop(
        ibans, pattern, matches, gaps, made
    )
