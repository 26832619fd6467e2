"""Format-preserving Feistel pseudonyms, in DataFrame operations only.

Method: personal numbers, dates and addresses are found by pattern, validated
(Luhn digit, octets, calendar, number plan) and replaced by a keyed permutation
of the values of the same format: equal values get equal pseudonyms in every
document, different values stay different, and the result is valid again.

A value becomes an array of digits, each with its own radix; a Feistel network
over the two halves adds, in every round, a keyed hash of one half to the other
half, digit by digit modulo the radix. That is a bijection whatever the radices
are, so no value needs cycle walking:

* card: all digits but the last, which is the new Luhn digit;
* ip: four octets; ssn: area (898 valid ones), group, serial;
* phone: number plan +1: area and exchange 200-999, line; others: all digits
  after the first two;
* date: the day within 1800-2199, whose 146,097 days are 189 x 773;
* email: letters and digits of the local part; secret: letters and digits of
  the value (all of them hexadecimal, or by class).

Patterns that match but do not validate stay as they are.

Defined cases: null text stays null, with 0 replacements; empty texts stay
empty; repeated rows get equal results; columns other than the text pass
through; there are no ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# fixed values: the shapes looked for, in order of precedence
SHAPES = {
    "secret": r"(?:(?<![A-Za-z])(?i:password|passwd|secret|token|api_key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{8,}+[\"']?|(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9]))",
    # as in any address at most 64 characters and 127 labels: an unbounded group recurses once a repeat
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[12][0-9]{3}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9]([/.])[0-3]?[0-9]\1[12][0-9]{3})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|(?<![0-9])\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4})(?![0-9])",
}
ANY = "|".join(SHAPES.values())
ROUNDS = 8
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def _ints(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


def permuted(digits: Column, radices: Column, key: str, kind: str) -> Column:
    """``digits`` (array of int below their ``radices``) under the permutation
    that ``key`` and ``kind`` choose."""
    def turn(acc, i):
        stream = F.sha2(F.concat_ws("/", F.lit(key), F.lit(kind), i.cast("string"), F.array_join(F.transform(acc["r"], lambda x: x.cast("string")), ",")), 512)
        shift = lambda j: F.conv(F.substr(stream, F.pmod(j, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        # the element is radix and value in one: both halves stay aligned
        moved = F.transform(F.arrays_zip(acc["l"], acc["lm"]), lambda x, j: F.pmod(x["l"] + shift(j), x["lm"]))
        return F.struct(acc["r"].alias("l"), acc["rm"].alias("lm"), moved.alias("r"), acc["lm"].alias("rm"))

    def network(d, m):
        half = F.size(d) - (F.size(d) / 2).cast("int")
        start = F.struct(F.slice(d, F.lit(1), half).alias("l"), F.slice(m, F.lit(1), half).alias("lm"),
                         F.slice(d, half + 1, F.size(d)).alias("r"), F.slice(m, half + 1, F.size(d)).alias("rm"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))

    return let(digits, lambda d: let(radices, lambda m: network(d, m)))


def _digits(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by those of the string."""
    def at(c, i):
        before = F.length(F.regexp_replace(F.substr(shape, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(F.regexp_like(c, F.lit("[0-9]")), F.substr(digits, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), at), "")


def _joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum (mod 10) of an array of digits, its last one not doubled."""
    n = F.size(digits)
    doubled = lambda x, i: F.when((n - 1 - i) % 2 == 1, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x)
    return F.aggregate(F.transform(digits, doubled), F.lit(0), lambda a, b: a + b) % 10


def _card(m: Column, key: str) -> Column:
    def replaced(d):
        new = permuted(F.slice(d, F.lit(1), F.size(d) - 1), F.transform(F.slice(d, F.lit(1), F.size(d) - 1), lambda _: F.lit(10)), key, "card")
        return let(new, lambda x: _refilled(m, F.concat(_joined(x), F.pmod(-_luhn(F.concat(x, _ints(0))), F.lit(10)).cast("string"))))

    return let(_digits(m), lambda d: F.when(_luhn(d) == 0, replaced(d)).otherwise(m))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda c: c.cast("int"))
    return F.array_join(F.transform(permuted(octets, _ints(256, 256, 256, 256), key, "ip"), lambda x: x.cast("string")), ".")


def _padded(x: Column, width: int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def _ssn(m: Column, key: str) -> Column:
    def parts(p):
        area, group, serial = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        index = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
        new = let(permuted(index, _ints(898, 99, 9999), key, "ssn"), lambda x: F.concat_ws(
            "-", _padded(F.when(F.get(x, F.lit(0)) >= 665, F.get(x, F.lit(0)) + 2).otherwise(F.get(x, F.lit(0)) + 1), 3),
            _padded(F.get(x, F.lit(1)) + 1, 2), _padded(F.get(x, F.lit(2)) + 1, 4)))
        return F.when(valid, new).otherwise(m)

    return let(F.transform(F.split(m, "-"), lambda c: c.cast("int")), parts)


def _phone(m: Column, key: str) -> Column:
    def plan(d):
        country = F.substr(d, F.lit(1), F.length(d) - 10)
        part = lambda a, n: F.substr(d, F.length(d) - a, F.lit(n)).cast("int")
        area, exchange, line = part(9, 3), part(6, 3), part(3, 4)
        one = (F.length(d) == 10) | ((F.length(d) == 11) & F.startswith(d, F.lit("1")))
        new = let(permuted(F.array(area - 200, exchange - 200, line), _ints(800, 800, 10000), key, "phone"), lambda x: F.concat(
            country, (F.get(x, F.lit(0)) + 200).cast("string"), (F.get(x, F.lit(1)) + 200).cast("string"), _padded(F.get(x, F.lit(2)), 4)))
        tail = F.substr(d, F.lit(3), F.length(d))
        other = F.concat(F.substr(d, F.lit(1), F.lit(2)), _joined(permuted(_digits(tail), F.transform(_digits(tail), lambda _: F.lit(10)), key, "phone+")))
        return _refilled(m, F.when(one & (area >= 200) & (exchange >= 200), new).otherwise(other))

    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.when(F.length(digits).between(8, 15), let(digits, plan)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso = F.regexp_like(m, F.lit("^[0-9]{4}-"))
    mark = F.when(F.contains(m, F.lit("/")), "/").otherwise(".")
    num = F.transform(F.split(m, "[-/.]"), lambda c: c.cast("int"))

    def parts(p):
        a, b, c = (F.lpad(F.get(p, F.lit(i)).cast("string"), w, "0") for i, w in enumerate((2, 2, 4)))
        dmy = F.try_to_timestamp(F.concat_ws("-", c, b, a), F.lit("yyyy-MM-dd")).cast("date")
        mdy = F.try_to_timestamp(F.concat_ws("-", c, a, b), F.lit("yyyy-MM-dd")).cast("date")
        ymd = F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")
        first = F.lit(FIRST_DAY).cast("date")

        def moved(day, pattern):
            n = F.datediff(day, first)
            new = permuted(F.array((n / DAYS[1]).cast("int"), n % DAYS[1]), _ints(*DAYS), key, "date")
            return let(new, lambda x: F.date_format(F.date_add(first, F.get(x, F.lit(0)) * DAYS[1] + F.get(x, F.lit(1))), pattern))

        shown = lambda day, pattern: F.when(day.between(first, F.lit("2199-12-31").cast("date")), moved(day, pattern))
        return F.coalesce(
            F.when(iso, shown(ymd, "yyyy-MM-dd")),
            F.when(~iso & dmy.isNotNull(), F.replace(shown(dmy, "dd/MM/yyyy"), F.lit("/"), mark)),
            F.when(~iso, F.replace(shown(mdy, "MM/dd/yyyy"), F.lit("/"), mark)), m)

    return let(num, parts)


def _characters(value: Column, key: str, kind: str) -> Column:
    """Letters and digits of ``value`` permuted within their classes; a value
    of lower-case hexadecimal digits stays one."""
    def coded(c, hexadecimal):
        return (F.when(hexadecimal, F.struct((F.instr(F.lit("0123456789abcdef"), c) - 1).alias("v"), F.lit(16).alias("m"), F.lit(0).alias("b")))
                .when(F.regexp_like(c, F.lit("[0-9]")), F.struct((F.ascii(c) - 48).alias("v"), F.lit(10).alias("m"), F.lit(48).alias("b")))
                .when(F.regexp_like(c, F.lit("[a-z]")), F.struct((F.ascii(c) - 97).alias("v"), F.lit(26).alias("m"), F.lit(97).alias("b")))
                .when(F.regexp_like(c, F.lit("[A-Z]")), F.struct((F.ascii(c) - 65).alias("v"), F.lit(26).alias("m"), F.lit(65).alias("b")))
                .otherwise(F.struct(F.lit(0).alias("v"), F.lit(1).alias("m"), F.ascii(c).alias("b"))))

    def shown(codes, hexadecimal):
        new = permuted(codes["v"], codes["m"], key, kind)
        return F.array_join(F.transform(F.arrays_zip(new.alias("v"), codes["m"].alias("m"), codes["b"].alias("b")), lambda x: F.when(
            hexadecimal, F.substr(F.lit("0123456789abcdef"), x["v"] + 1, F.lit(1))).otherwise(F.chr(x["v"] + x["b"]))), "")

    # asked once for the value, not once for each of its characters
    return let(F.regexp_like(value, F.lit("^(?=[a-f]*[0-9])[0-9a-f]++$")), lambda hexadecimal: let(
        F.transform(F.split(value, ""), lambda c: coded(c, hexadecimal)), lambda codes: shown(codes, hexadecimal)))


def _email(m: Column, key: str) -> Column:
    return F.concat(_characters(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    pattern = "^(AKIA|[A-Za-z_]+\\s*[=:]\\s*[\"']?)([A-Za-z0-9_+/-]+)([\"']?)$"
    group = lambda i: F.regexp_extract(m, pattern, i)
    return F.concat(group(1), _characters(group(2), key, "secret"), group(3))


_KINDS = {"secret": _secret, "email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one match, by the first shape that it has throughout."""
    out = match
    for kind in reversed(SHAPES):
        shape = SHAPES[kind].replace(r"\2", r"\1").replace(r"\3", r"\2") if kind == "card" else SHAPES[kind]
        out = F.when(F.regexp_like(match, F.lit(f"^(?:{shape})$")), _KINDS[kind](match, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the personal values of the text replaced; ``count_col``
    names an extra column for the number of replaced values."""
    text = F.col(text_col)
    # every shape holds one of these
    found = F.when(F.regexp_like(text, F.lit("[0-9@=:]|AKIA")), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))

    whole = let(found, lambda old: F.when(F.size(old) > 0, let(F.split(text, ANY, -1), lambda between: _woven(between, old, key))))
    out = docs.withColumn("_new", whole)
    names = [F.coalesce(F.col("_new.text"), text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    extra = [F.coalesce(F.col("_new.n"), F.lit(0).cast("long")).alias(count_col)] if count_col else []
    return out.select(*names, *extra)


def _woven(between: Column, old: Column, key: str) -> Column:
    """The text between the matches and their pseudonyms, put together."""
    return let(F.transform(old, lambda m: pseudonym(m, key)), lambda new: F.struct(
        F.concat(F.array_join(F.transform(new, lambda x, i: F.concat(F.get(between, i), x)), ""), F.element_at(between, -1)).alias("text"),
        F.aggregate(F.zip_with(old, new, lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b).alias("n")))
