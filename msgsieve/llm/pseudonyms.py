"""Format-preserving pseudonyms for personal data, by Feistel networks over each format.

A keyed permutation maps every value of a format to another value of the same format,
so a value gets the same pseudonym wherever it occurs, two values never share one, and
the key holder can invert it.  The permuted domains are:

=========  =====================================  ==========================================
kind       accepted if                            what is permuted
=========  =====================================  ==========================================
card       13-19 digits, plain or in the groups   digits but the first and the check digit,
           of cards, Luhn sum is right            which is computed anew
phone      ``+`` and 8 digits or more, or (ddd)   digits after the country code
           ddd-dddd and ddd-ddd-dddd
iban       two capitals, 13-32 digits or          letters and digits after the first four;
           capitals, plain or in fours, whose     the two check digits are computed anew
           remainder by 97 is right
ip         four numbers up to 255                 all 32 bits
date       a real day of 1900-2099, written       the day among those 73,049; among the
           y-m-d, y/m/d, d.m.y, m/d/y, or else    44,249 after a month's twelfth for d/m/y
           d/m/y
ssn        ddd-dd-dddd with an assignable area    the 898 x 99 x 9999 assignable numbers
email      name@domain                            letters and digits of the name
key        AKIA and 16 capitals or digits         those 16
hex        32 or more hexadecimal digits with a   all digits
           decimal one among them
secret     value with a digit after a word such   letters and digits of the value; all
           as ``password=``                       digits where it is hexadecimal
=========  =====================================  ==========================================

Numbers that look alike but fail the test stay as they are.  Separators stay in place
and do not count, so ``4111 1111 ...`` and ``41111111...`` remain linked, and so do
``+49 30 ...`` and ``+4930...``, as country codes come from the numbering plan.

A value of any length costs work in proportion to it: patterns repeat single characters
or groups that are never given back, so none recurses, and a round of a network hashes
the other half once and takes the moves of its characters from that digest.

Everything is a built-in expression: the text is cut at the matches of one pattern,
matches are replaced and the parts are joined again.  Texts without a digit or ``@``
are not searched.

Cases: a null or empty text stays; repeated rows and values give equal results; an
empty table gives an empty result; only the named columns are used, so others may have
any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgsieve.functions.evaluation import bind, computed_once
from msgsieve.llm.tables import DOCUMENT_COLUMNS, as_documents, read

ROUNDS = 8
DEFAULT_KEY = "change-me"  # production: a secret, passed as ``key`` or set in the session
KEY_SETTING = "spark.msgsieve.pseudonym.key"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SECRET_WORD = r"(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?"
_SECRET_VALUE = r"(?=[A-Za-z_/+-]*\d)[A-Za-z0-9_/+-]{8,}"
# In this order; the first that matches at a place counts.
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9])" + _SECRET_WORD + _SECRET_VALUE,
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?!\.)[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "hex": r"(?<![A-Za-z0-9])(?:(?=[a-f]*\d)[0-9a-f]{32,}+|(?=[A-F]*\d)[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:(?:19|20)\d\d([/-])\d\d\1\d\d|\d\d?\.\d\d?\.(?:19|20)\d\d|\d\d?/\d\d?/(?:19|20)\d\d)(?![\d/-]|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    # digits that belong to a following address or decimal number are given back
    "phone": r"(?<![\d+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
             r"|(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d|\.\d)"
             r"|(?<![\d)])\(\d{3}\)[ .-]?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
KINDS = list(PATTERNS)

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
HEX = ["0123456789abcdef"]
UPPER_HEX = ["0123456789ABCDEF"]
ALNUM = [DIGITS, LOWER, LOWER.upper()]
CAPITALS_AND_DIGITS = [DIGITS, LOWER.upper()]
FIRST_DAY, DAY_FACTORS = "1900-01-01", (319, 229)  # 319 * 229 = the days of 1900-2099
LATE_DAY_FACTORS = (4297, 17)  # 4297 * 17 = those of them after the twelfth of a month
# Country calling codes of one and two digits; all others have three.
ONE_DIGIT_CODES = ["1", "7"]
TWO_DIGIT_CODES = [
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
    "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66",
    "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
]
MOVES = 6  # of ten hexadecimal digits each, from one digest


def _number(*parts: Column) -> Column:
    """A keyed pseudo-random number of 48 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12), 16, 10).cast("bigint")


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def permute_text(value: Column, key: Column, tweak: str, classes: list[str]) -> Column:
    """Feistel network over the halves of a string.

    In each round every character of one half moves within its class by an amount that
    the other half determines; characters of no class stay.
    """

    def moved(half: Column, other: Column, turn: Column) -> Column:
        blocks = bind(_digest(key, F.lit(tweak), turn.cast("string"), other), lambda d: F.transform(
            F.sequence(F.lit(0), F.floor(F.length(half) / MOVES).cast("int")), lambda b: _digest(d, b.cast("string"))))

        def char(here: Column, i: Column, digests: Column) -> Column:
            part = F.substring(F.get(digests, F.floor(i / MOVES).cast("int")), 10 * (i % MOVES) + 1, F.lit(10))
            move = F.conv(part, 16, 10).cast("bigint")
            result = here
            for symbols in classes:
                at = F.instr(F.lit(symbols), here) - 1
                result = F.when(at >= 0, F.substring(
                    F.lit(symbols), ((at + move) % len(symbols) + 1).cast("int"), F.lit(1))).otherwise(result)
            return result

        # split once: taking single characters by place would read all before them each time
        letters = F.array_join(bind(blocks, lambda d: F.transform(F.split(half, ""), lambda c, i: char(c, i, d))), "")
        return F.when(F.length(half) == 0, half).otherwise(letters)

    def network(text: Column) -> Column:
        middle = F.floor(F.length(text) / 2).cast("int")
        start = F.struct(F.substring(text, F.lit(1), middle).alias("l"),
                         F.substring(text, middle + 1, F.length(text)).alias("r"))
        return F.aggregate(
            F.array(*[F.lit(i) for i in range(ROUNDS)]), start,
            lambda s, i: F.struct(s["r"].alias("l"), moved(s["l"], s["r"], i).alias("r")),
            lambda s: F.concat(s["l"], s["r"]))

    return bind(value, network)


def permute_pair(x: Column, y: Column, sizes: tuple[int, int], key: Column, tweak: str) -> Column:
    """Feistel network over 0..a-1 times 0..b-1, as a struct of ``x`` and ``y``."""
    a, b = sizes
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        move = _number(key, F.lit(tweak), i.cast("string"), F.when(even, s["y"]).otherwise(s["x"]).cast("string"))
        return F.struct(F.when(even, (s["x"] + move) % a).otherwise(s["x"]).alias("x"),
                        F.when(even, s["y"]).otherwise((s["y"] + move) % b).alias("y"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _refill(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced in order."""
    def char(i: Column) -> Column:
        here = F.substring(template, i, F.lit(1))
        return F.when(here.between("0", "9"),
                      F.substring(digits, F.length(_digits(F.substring(template, F.lit(1), i))), F.lit(1))).otherwise(here)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(template)), char), "")


def luhn_sum(digits: Column) -> Column:
    """Of digits without a check digit: the check digit makes this a multiple of ten."""
    def part(i: Column) -> Column:
        twice = 2 * F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(F.floor(twice / 2).cast("int"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), part), F.lit(0), lambda a, x: a + x)


def _card(found: Column, key: Column) -> Column:
    def of(digits: Column) -> Column:
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        right = (luhn_sum(body) + F.substring(digits, F.length(digits), F.lit(1)).cast("int")) % 10 == 0
        moved = F.concat(F.substring(digits, 1, 1), permute_text(
            F.substring(body, F.lit(2), F.length(body)), key, "card", [DIGITS]))
        checked = bind(moved, lambda m: F.concat(m, ((10 - luhn_sum(m) % 10) % 10).cast("string")))
        return F.when(right, bind(checked, lambda d: _refill(found, d))).otherwise(found)

    return bind(_digits(found), of)


def _phone(found: Column, key: Column) -> Column:
    def of(digits: Column) -> Column:
        code = (F.when(~found.startswith("+"), 0).when(F.substring(digits, 1, 1).isin(ONE_DIGIT_CODES), 1)
                .when(F.substring(digits, 1, 2).isin(TWO_DIGIT_CODES), 2).otherwise(3))
        rest = F.substring(digits, code + 1, F.length(digits))
        made = F.concat(F.substring(digits, F.lit(1), code), permute_text(rest, key, "phone", [DIGITS]))
        fits = (F.length(digits) >= 8) | ~found.startswith("+")
        return F.when(fits, bind(made, lambda d: _refill(found, d))).otherwise(found)

    return bind(_digits(found), of)


def remainder_97(text: Column) -> Column:
    """Of digits and capitals, which stand for 10 to 35."""
    def add(total: Column, here: Column) -> Column:
        value = F.instr(F.lit(DIGITS + LOWER.upper()), here) - 1
        return (total * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(found: Column, key: Column) -> Column:
    def of(plain: Column) -> Column:
        country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        right = remainder_97(F.concat(body, F.substring(plain, 1, 4))) == 1

        def checked(moved: Column) -> Column:
            check = 98 - remainder_97(F.concat(moved, country, F.lit("00")))
            return F.concat(country, F.lpad(check.cast("string"), 2, "0"), moved)

        made = bind(permute_text(body, key, "iban", CAPITALS_AND_DIGITS), checked)
        spaced = F.rtrim(F.regexp_replace(made, "(.{4})", "$1 "))
        return F.when(right, F.when(F.contains(found, F.lit(" ")), spaced).otherwise(made)).otherwise(found)

    return bind(F.replace(found, F.lit(" "), F.lit("")), of)


def _ip(found: Column, key: Column) -> Column:
    def of(n: Column) -> Column:
        def octet(i: int) -> Column:
            return F.get(n, i).cast("bigint")

        moved = permute_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), (65536, 65536), key, "ip")
        return bind(moved, lambda s: F.concat_ws(".", *[
            c.cast("string") for v in (s["x"], s["y"]) for c in (F.floor(v / 256), v % 256)]))

    return bind(F.split(found, r"\."), of)


def _months(day: Column) -> Column:
    return (F.year(day) - 1900) * 12 + F.month(day) - 1


def _moved_day(day: Column, key: Column) -> Column:
    """Any day of 1900-2099 to another one."""
    a, b = DAY_FACTORS
    number = F.date_diff(day, F.to_date(F.lit(FIRST_DAY)))
    moved = permute_pair(F.floor(number / b), number % b, (a, b), key, "date")
    return bind(moved, lambda s: F.date_add(F.to_date(F.lit(FIRST_DAY)), (s["x"] * b + s["y"]).cast("int")))


def _moved_late_day(day: Column, key: Column) -> Column:
    """A day after the twelfth of its month to another such day; they are numbered without the others."""
    a, b = LATE_DAY_FACTORS
    first = F.to_date(F.lit(FIRST_DAY))
    number = F.date_diff(day, first) - 12 * (_months(day) + 1)
    moved = permute_pair(F.floor(number / b), number % b, (a, b), key, "late date")

    def back(n: Column) -> Column:
        guess = F.floor(n / 18.4371).cast("int")  # of a month's days 18.4371 come after the twelfth, on average
        found = [bind(guess + i, lambda m: bind(F.date_add(first, n + 12 * (m + 1)), lambda d: F.when(
            (_months(d) == m) & (F.dayofmonth(d) > 12), d))) for i in (-1, 0, 1)]
        return F.coalesce(*found)

    return bind(bind(moved, lambda s: (s["x"] * b + s["y"]).cast("int")), back)


def _date(found: Column, key: Column) -> Column:
    def written(read: str, write: str, shape: str, moved=_moved_day) -> Column:
        def shown(day: Column) -> Column:
            # digits that stand alone stay so: a day has one spelling of each width
            return F.when(F.length(found) < len(write), F.date_format(day, read)).otherwise(F.date_format(day, write))

        day = F.try_to_timestamp(F.when(found.rlike(shape), found), F.lit(read)).cast("date")
        return bind(day, lambda d: F.when(d.isNotNull(), bind(moved(d, key), shown)))

    return F.coalesce(
        written("yyyy-MM-dd", "yyyy-MM-dd", r"^\d{4}-"), written("yyyy/MM/dd", "yyyy/MM/dd", r"^\d{4}/"),
        written("d.M.yyyy", "dd.MM.yyyy", r"^\d\d?\."), written("M/d/yyyy", "MM/dd/yyyy", r"^\d\d?/"),
        written("d/M/yyyy", "dd/MM/yyyy", r"^\d\d?/", _moved_late_day), found)


def _ssn(found: Column, key: Column) -> Column:
    def of(n: Column) -> Column:
        area, group, serial = (F.get(n, i).cast("bigint") for i in range(3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        index = area - 1 - F.when(area > 666, 1).otherwise(0)
        moved = permute_pair(index, (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "ssn")
        text = bind(moved, lambda s: F.concat_ws(
            "-", F.lpad((s["x"] + 1 + F.when(s["x"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"),
            F.lpad((F.floor(s["y"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((s["y"] % 9999 + 1).cast("string"), 4, "0")))
        return F.when(valid, text).otherwise(found)

    return bind(F.split(found, "-"), of)


def _hex(found: Column, key: Column) -> Column:
    return F.when(found.rlike("^[0-9a-f]+$"), permute_text(found, key, "hex", HEX)).otherwise(
        permute_text(found, key, "hex", UPPER_HEX))


def _secret(found: Column, key: Column) -> Column:
    def of(word: Column) -> Column:
        value = F.substring(found, F.length(word) + 1, F.length(found))
        return F.concat(word, F.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), _hex(value, key)).otherwise(
            permute_text(value, key, "secret", ALNUM)))

    return bind(F.regexp_extract(found, "^" + _SECRET_WORD, 0), of)


def _email(found: Column, key: Column) -> Column:
    name = F.substring_index(found, "@", 1)
    return F.concat(permute_text(name, key, "email", ALNUM), F.lit("@"), F.substring_index(found, "@", -1))


def kind_of(found: Column) -> Column:
    """Which pattern a match belongs to; matches keep no context, so patterns are anchored."""
    def whole(pattern: str) -> str:
        return "^(?:" + pattern + ")$"

    tests = [F.when(found.rlike(whole(PATTERNS[k])), F.lit(k)) for k in KINDS]
    return F.coalesce(*tests, F.lit("secret"))


def pseudonym(found: Column, kind: Column, key: Column) -> Column:
    made = {
        "secret": _secret(found, key), "email": _email(found, key), "date": _date(found, key), "ip": _ip(found, key),
        "key": F.concat(F.lit("AKIA"), permute_text(F.substring(found, 5, 16), key, "key", ALNUM)),
        "hex": _hex(found, key),
        "iban": _iban(found, key), "ssn": _ssn(found, key), "phone": _phone(found, key), "card": _card(found, key),
    }
    return reduce(lambda rest, k: F.when(kind == k, made[k]).otherwise(rest), KINDS, found)


def replace_private(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` pseudonymised, and ``replaced``: array of structs of kind, value and pseudonym.

    ``replaced`` must not be a column of ``docs``; it holds private values, so drop it before publishing.
    """
    body = F.col(f"`{text}`")
    secret = F.lit(key)
    none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")

    def found(value: Column) -> Column:
        def known(kind: Column) -> Column:
            return F.struct(kind.alias("kind"), value.alias("value"), pseudonym(value, kind, secret).alias("pseudonym"))

        return bind(kind_of(value), known)

    def rebuilt(value: Column) -> Column:
        matches = F.transform(F.regexp_extract_all(value, F.lit(PATTERN), F.lit(0)), found)

        def join(m: Column) -> Column:
            new = F.concat(F.transform(m, lambda x: x["pseudonym"]), F.array(F.lit("")))
            text = F.array_join(F.zip_with(F.split(value, PATTERN, -1), new, lambda part, m: F.concat(part, m)), "")
            return F.struct(text.alias("t"), F.filter(m, lambda x: x["value"] != x["pseudonym"]).alias("r"))

        return bind(matches, join)

    may = body.rlike("[0-9@]")
    result = F.when(may, bind(body, rebuilt)).otherwise(F.struct(body.alias("t"), none.alias("r")))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    made = computed_once(docs.select(*others, body), {"_made": result})
    order = [F.col("_made")["t"].alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return made.select(*order, F.col("_made")["r"].alias("replaced"))


def session_key(spark: SparkSession) -> str:
    """The key that the session sets for all jobs whose values should stay linked."""
    return spark.conf.get(KEY_SETTING, DEFAULT_KEY)


def pseudonym_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: the documents without private values."""
    return replace_private(as_documents(docs), session_key(spark)).select(*DOCUMENT_COLUMNS)


def op1_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    done = replace_private(read(spark, folder, "documents").select("doc_id", "text"), session_key(spark))

    def found(kind: str) -> Column:
        return F.size(F.filter("replaced", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return done.select("doc_id", "text", F.size("replaced").cast("bigint").alias("n_replaced"),
                       *map(found, KINDS))
