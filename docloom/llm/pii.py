"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key of the registered query. A deployment passes its own.
KEY = "docloom-pseudonym-key"
ROUNDS = 8

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: One alternation, most specific first; the named kinds are told apart again on the short matches.
EMAIL = r"[\p{L}\p{M}\p{N}._%+-]{1,64}@[\p{L}\p{M}\p{N}-]{1,63}(?:\.[\p{L}\p{M}\p{N}-]{1,63})*\.[\p{L}\p{M}]{2,24}"
IPV4 = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
DATE = (
    r"(?<![0-9A-Za-z-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])"
    r"|(?<![0-9A-Za-z/.])[0-9]{2}(?<ds>[/.])[0-9]{2}\k<ds>(?:19|20)[0-9]{2}(?![0-9/])"
)
#: +1 has ten digits more. Others have 8 to 15 in all, and do not end inside a longer number, a date or an address.
PHONE = (
    r"(?<![0-9+])\+(?:1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|[2-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9]|[.-][0-9]))"
)
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
NUMBER = (
    r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?<ns>[ -])[0-9]{4}\k<ns>[0-9]{4}\k<ns>[0-9]{1,7}"
    r"|3[47][0-9]{2}(?<nt>[ -])[0-9]{6}\k<nt>[0-9]{5})(?![0-9A-Za-z-])"
)
PATTERN = "|".join([EMAIL, IPV4, DATE, PHONE, SSN, IBAN, NUMBER])
#: Before the regular expressions run in full, a text must hold one of these.
HINT = r"[0-9@]"
#: Country codes of two digits; 1 and 7 have one, all others three. Fixed values.
_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def feistel(values: Column, radices: Column, key: str, tweak: Column, rounds: int = ROUNDS) -> Column:
    """Permute the arrays of numbers below ``radices``, position by position, among themselves.

    In turns, one half of the positions is moved by amounts that a SHA-512 over key, tweak, round and
    the other half gives, each modulo its radix; so every round, and the whole, is a bijection. A
    half has up to 32 positions with amounts of their own; further ones share them.
    """
    n = F.size(values)
    half = F.floor(n / 2).cast("int")

    def turn(state: Column, r: Column) -> Column:
        left = r % 2 == 1
        other = F.when(left, F.slice(state, half + 1, n)).otherwise(F.slice(state, F.lit(1), half))
        seed = F.concat_ws("|", F.lit(key), tweak, n.cast("string"), r.cast("string"), F.array_join(other.cast("array<string>"), ","))

        def moved(digest: Column) -> Column:
            def one(v: Column, i: Column) -> Column:
                amount = F.conv(F.substring(digest, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
                return F.when((i < half) == left, (v + amount) % radices[i]).otherwise(v)

            return F.transform(state, one)

        return let(F.sha2(seed, 512), moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), values, turn)


#: Runs of letters and digits, by first code point and length: each sign moves within its run. Those of other scripts stay.
#: Digits and letters of ASCII, Latin (small, capital, extended), Greek, Cyrillic, kana, Chinese, Hangul. Fixed values.
RUNS = [
    (48, 10), (97, 26), (65, 26), (224, 23), (248, 7), (192, 23), (216, 7), (256, 128), (945, 25), (913, 17),
    (1072, 32), (1040, 32), (12353, 86), (12449, 90), (19968, 20992), (44032, 11172),
]


def permute_symbols(text: Column, key: str, tweak: Column, runs: list[tuple[int, int]] = RUNS[:3]) -> Column:
    """Permute texts of one pattern of signs: each within its run of ``runs`` (ASCII digits, small letters, capitals); others stay."""

    def pick(c: Column, run: Column, other: Column) -> Column:
        out = F.when(c.between(runs[0][0], runs[0][0] + runs[0][1] - 1), run(runs[0]))
        for r in runs[1:]:
            out = out.when(c.between(r[0], r[0] + r[1] - 1), run(r))
        return out.otherwise(other)

    def sign(c: Column) -> Column:
        wide = F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
        return F.char(c) if runs == RUNS[:3] else F.when(c < 128, F.char(c)).otherwise(wide)

    def whole(codes: Column) -> Column:
        radix = F.transform(codes, lambda c: pick(c, lambda r: F.lit(r[1]), F.lit(1)))
        base = lambda c: pick(c, lambda r: F.lit(r[0]), c)
        values = F.transform(codes, lambda c: c - base(c))
        new = let(values, lambda v: let(radix, lambda r: feistel(v, r, key, tweak)))
        return F.array_join(F.zip_with(codes, new, lambda c, v: let(base(c) + v, sign)), "")

    return F.when(F.length(text) == 0, text).otherwise(let(F.transform(F.split(text, ""), F.ascii), whole))


def _fixed(values: list[Column], radices: list[int], key: str, tweak: str) -> Column:
    """A few numbers of different ranges, permuted together; an array."""
    return let(F.array(*[v.cast("int") for v in values]), lambda v: feistel(v, F.array(*map(F.lit, radices)), key, F.lit(tweak)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(pattern: Column, symbols: Column) -> Column:
    """Put ``symbols`` in the places of letters and digits of ``pattern``; signs stay where they were."""
    end = F.aggregate(
        F.split(pattern, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, ch: F.when(
            ch.rlike("^[0-9A-Za-z]$"),
            F.struct(F.concat(acc["out"], F.substring(symbols, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(acc["out"], ch).alias("out"), acc["at"].alias("at"))),
    )
    return end["out"]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum modulo ten; 0 for a valid number with its check digit."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c: F.coalesce(c.cast("int"), F.lit(0)))
    return F.aggregate(
        F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v))),
        F.lit(0),
        lambda a, v: a + v,
        lambda a: a % 10,
    )


def _card(m: Column, key: str) -> Column:
    """All digits but the last are permuted; the last is the new check digit."""

    def whole(d: Column) -> Column:
        body = permute_symbols(F.substring(d, F.lit(1), F.length(d) - 1), key, F.lit("number"))
        return let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0")))) % 10).cast("string")))

    return _refill(m, let(_digits(m), whole))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-665 and 667-899, groups 01-99 and serials 0001-9999 are valid, and go to such again."""
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    new = _fixed([F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1], [898, 99, 9999], key, "ssn")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return let(new, lambda v: F.concat_ws("-", pad(F.when(v[0] > 664, v[0] + 2).otherwise(v[0] + 1), 3), pad(v[1] + 1, 2), pad(v[2] + 1, 4)))


def _valid_ssn(m: Column) -> Column:
    return ~m.rlike("^(?:000|666|9)|-00-|-0000$")


def _phone(m: Column, key: str) -> Column:
    """The country code stays, as it decides the format; all other digits are permuted, whatever the signs between."""

    def whole(d: Column) -> Column:
        size = F.when(d.rlike("^[17]"), 1).when(F.substring(d, 1, 2).isin(_CODES), 2).otherwise(3)
        return let(
            size,
            lambda k: F.concat(
                F.substring(d, F.lit(1), k),
                permute_symbols(F.substring(d, k + 1, F.length(d)), key, F.concat(F.lit("phone"), F.substring(d, F.lit(1), k))),
            ),
        )

    return _refill(m, let(_digits(m), whole))


def _ipv4(m: Column, key: str) -> Column:
    octets = let(F.split(m, r"\.").cast("array<int>"), lambda v: feistel(v, F.array(*[F.lit(256)] * 4), key, F.lit("ipv4")))
    return F.array_join(octets.cast("array<string>"), ".")


#: 1900-01-01 to 2099-12-31 are 17 * 4297 days.
_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)


def _day(m: Column) -> Column:
    """The date that a match writes: year first, else day first, else month first; null if there is none."""
    tries = [(m, "yyyy-MM-dd")] + [(F.regexp_replace(m, "[/.]", "-"), f) for f in ("dd-MM-yyyy", "MM-dd-yyyy")]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for c, f in tries]).cast("date")


def _date(m: Column, key: str) -> Column:
    """A calendar date from 1900 to 2099 goes to another one, written in the same order and with the same signs."""
    first = F.lit(_FIRST_DAY).cast("date")
    n = F.datediff(_day(m), first)
    new = _fixed([F.floor(n / _DAYS[1]), n % _DAYS[1]], list(_DAYS), key, "date")
    day = let(new, lambda v: F.date_add(first, v[0] * _DAYS[1] + v[1]))
    swapped = F.try_to_timestamp(F.regexp_replace(m, "[/.]", "-"), F.lit("dd-MM-yyyy")).isNull()  # month first
    mark = F.substring(m, 3, 1)

    def written(t: Column) -> Column:
        y, mo, d = F.substring(t, 1, 4), F.substring(t, 6, 2), F.substring(t, 9, 2)
        return F.when(m.rlike("^[0-9]{4}-"), t).when(swapped, F.concat(mo, mark, d, mark, y)).otherwise(F.concat(d, mark, mo, mark, y))

    return let(F.date_format(day, "yyyy-MM-dd"), written)


def _mod97(text: Column) -> Column:
    """The remainder of digits and capitals (A is 10, Z is 35) read as one number."""

    def more(r: Column, c: Column) -> Column:
        return F.when(c < 58, r * 10 + (c - 48)).otherwise(r * 100 + (c - 55)) % 97

    return F.aggregate(F.transform(F.split(text, ""), F.ascii), F.lit(0), more)


def _iban_part(m: Column) -> Column:
    """The longest run of groups from the start whose check digits are right; null if there is none."""

    def right(s: Column) -> Column:
        plain = F.replace(s, F.lit(" "), F.lit(""))
        return (F.length(plain) >= 15) & (_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)

    def runs(groups: Column) -> Column:
        return F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))

    return F.get(F.filter(let(F.split(m, " "), runs), right), F.lit(0))


def _iban(m: Column, key: str) -> Column:
    """Country and pattern stay, the account is permuted and the check digits are computed anew."""

    def whole(part: Column) -> Column:
        plain = F.replace(part, F.lit(" "), F.lit(""))
        land = F.substring(plain, 1, 2)
        account = permute_symbols(F.substring(plain, F.lit(5), F.length(plain)), key, F.concat(F.lit("iban"), land))

        def checked(a: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(a, land, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(land, check, a)

        return F.concat(_refill(part, let(account, checked)), F.substring(m, F.length(part) + 1, F.length(m)))

    return let(_iban_part(m), whole)


def _email(m: Column, key: str) -> Column:
    """The part before the ``@`` is permuted within its pattern of letters, digits and signs; the domain stays.

    Capitals count as their small letters, so an address stays linked however it is written."""
    at = F.instr(m, "@")
    domain = F.substring(m, at, F.length(m))
    return F.concat(permute_symbols(F.substring(m, F.lit(1), at - 1), key, F.concat(F.lit("email"), F.lower(domain)), RUNS), domain)


def kind_of(m: Column) -> Column:
    """The kind of one match; null where its validation fails: a day that no month has, an area that no
    number of the form 123-45-6789 has, wrong check digits of an account or a card."""
    return (
        F.when(F.instr(m, "@") > 0, F.lit("email"))
        .when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), F.lit("ipv4"))
        .when(m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})$"), F.when(_day(m).isNotNull(), "date"))
        .when(m.rlike(r"^\+"), F.lit("phone"))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(_valid_ssn(m), "ssn"))
        .when(m.rlike("^[A-Z]"), F.when(_iban_part(m).isNotNull(), "iban"))
        .otherwise(F.when(luhn_sum(_digits(m)) == 0, "number"))
    )


def pseudonym(m: Column, kind: Column, key: str = KEY) -> Column:
    """The pseudonym of a match of this kind; of a null kind the match itself."""
    return (
        F.when(kind == "email", _email(m, key))
        .when(kind == "ipv4", _ipv4(m, key))
        .when(kind == "date", _date(m, key))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "iban", _iban(m, key))
        .when(kind == "number", _card(m, key))
        .otherwise(m)
    )


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str = KEY, count_col: str | None = None) -> DataFrame:
    """Replace personal data in a text column by keyed values of the same format.

    Email addresses, IPv4 addresses, dates of 1900-2099 (year, day or month first), international
    phone numbers, numbers of the form 123-45-6789, IBANs and card numbers of 13 to 19 digits are
    found and validated; what fails its validation stays. The pseudonym is valid again. Equal values
    get equal pseudonyms in every document, whatever signs stand between the digits, and different
    ones of a kind and format get different ones. Digits that follow a phone number outside +1 after
    a space, and fit its 15, are taken as part of it.

    Texts without such values stay as they are, byte for byte; a null text stays null (count 0), an
    empty one empty. All rows, repeated ones too, and all other columns are kept; ``count_col`` adds
    the number of replaced values, in place of a column of that name. There is no shuffle: each row
    is handled where it is read.
    """
    text = F.col(f"`{text_col}`")
    taken = {c.lower() for c in docs.columns}
    staged_col = next(n for i in range(len(taken) + 1) if (n := f"found{i}") not in taken)
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    swap = lambda m: let(kind_of(m), lambda k: F.struct(k.alias("kind"), pseudonym(m, k, key).alias("new")))
    staged = docs.withColumn(staged_col, F.coalesce(F.transform(found, swap), F.array().cast("array<struct<kind: string, new: string>>")))
    new = F.concat(F.col(staged_col)["new"], F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(F.split(text, PATTERN, -1), new, lambda gap, x: F.concat(gap, x)), "")
    count = F.size(F.filter(staged_col, lambda s: s["kind"].isNotNull()))
    out = staged.withColumn(text_col, F.when(count > 0, rebuilt).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, count.cast("long"))
    return out.drop(staged_col)


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table with its pseudonymized text and the number of replaced values."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymize(docs, count_col="n_replaced")
