"""PII: keyed Feistel pseudonyms that keep the format and the validity of what they replace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.llm.common import packed, table

ROUNDS = 10
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Kinds in the order in which they are tried at a place of the text.
PATTERNS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "email": r"(?<![\p{L}0-9._%+\-@])[\p{L}0-9._%+\-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}",
    "date": r"(?<![0-9/.\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/\-.][0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9.,\-])[0-9](?:[ \-]?[0-9]){12,18}(?![A-Za-z0-9]|-[0-9])",
}
_DOMESTIC = r"\([0-9]{3}\) ?[0-9]{3}[\-. ][0-9]{4}|[0-9]{3}[\-.][0-9]{3}[\-.][0-9]{4}"
#: What ends a candidate before it: the other values that begin with a digit.
_OTHER = "|".join([*(PATTERNS[k] for k in ("email", "date", "ssn", "ip")), rf"(?<![A-Za-z0-9])(?:{_DOMESTIC})(?![0-9])"])
_PLUS = r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})"
#: 7 to 15 digits since the plus; looked at from the end, so that a longer reading gives way to a shorter one.
_ONE = r"[ .\-()]?[ .\-()]?[0-9]"
_PHONE_DIGITS = rf"(?<=\+{_ONE * 7}{f'(?:{_ONE}' * 8}{')?' * 8})"
#: The usual groupings of cards. Several in a row, with no further group of four, mark a border most surely.
_CARD = r"(?:[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}|[0-9]{4}[ \-]?[0-9]{6}[ \-]?[0-9]{4,5}|[0-9]{13,19})"
_CARDS = rf"{_CARD}(?: {_CARD})*+(?![A-Za-z0-9]|-[0-9]| [0-9]{{4}}(?![0-9./\-]))"
#: Up to cards, else up to any value that leaves a number, else the whole.
_INTERNATIONAL = "|".join(
    rf"{_PLUS}(?:[ .\-]?{stop}[0-9]{{2,4}}){{2,4}}(?![0-9]){end}{_PHONE_DIGITS}"
    for stop, end in ((rf"(?!{_OTHER})", rf"(?= {_CARDS})"), (rf"(?!{_OTHER}|{_CARD}(?![A-Za-z0-9]|-[0-9]))", ""), ("", ""))
)
PATTERNS = {**{k: v for k, v in PATTERNS.items() if k != "card"}, "phone": rf"(?<![A-Za-z0-9])(?:{_INTERNATIONAL}|{_DOMESTIC})(?![0-9])", "card": PATTERNS["card"]}
#: IBANs and cards are found as runs of groups parted by single blanks, which _readings() cuts by
#: their check digits. Possessive, so that long runs need no stack.
_GROUP = r"[A-Z0-9]++(?![A-Za-z0-9])"
_DIGIT_GROUP = r"[0-9]++(?:-[0-9]++)*+(?![A-Za-z0-9])"
RUNS = {
    "iban": rf"(?={PATTERNS['iban']}){_GROUP}(?: (?!{_OTHER}|[0-9]++-[0-9]++-[0-9]){_GROUP})*+",
    "card": rf"(?<![A-Za-z0-9.,\-])(?=[0-9](?:(?: (?!{_OTHER})|-)?[0-9]){{12}}){_DIGIT_GROUP}(?: (?!{_OTHER}){_DIGIT_GROUP})*+",
}
_IS_RUN = r"^(?:[A-Z]{2}[0-9]{2}[A-Z0-9 ]*|(?=[0-9](?:[ \-]?[0-9]){12})[0-9 \-]*)$"
#: Groups of one reading at most, and a letter for each number of groups; x is a group outside of all readings.
MOST_GROUPS = 19
_LETTERS = "abcdefghijklmnopqrs"
_PIECES = "|".join(["x[A-Z0-9-]+", *(rf"{c}[A-Z0-9-]+(?: [a-z][A-Z0-9-]+){{{n}}}" for n, c in enumerate(_LETTERS))])
ANY = "|".join((PATTERNS | RUNS).values())
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Days of the 400-year Gregorian cycle from 1800-01-01, as an exact product of two radices.
CYCLE_START, CYCLE_RADICES = "1800-01-01", (189, 773)
#: Steps of the cycle walk that keeps days 1-12 and the others apart; at worst 0.6^64 of the dates miss.
WALK = 64


def _prf(key: Column, tweak: Column, turn: Column, value: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", key, tweak, turn.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, key: Column, tweak: Column, back: bool = False) -> Column:
    """A keyed permutation of pairs (a, b), 0 <= a < mod_a and 0 <= b < mod_b, as a struct.

    An alternating Feistel network over two radices: exact on its domain, so no cycle walking.
    back: the inverse.
    """
    sign = -1 if back else 1

    def turn(acc: Column, r: Column) -> Column:
        even = (r % 2) == 0
        left = F.when(even, F.pmod(acc["a"] + F.lit(sign) * F.pmod(_prf(key, tweak, r, acc["b"]), mod_a), mod_a)).otherwise(acc["a"])
        right = F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + F.lit(sign) * F.pmod(_prf(key, tweak, r, acc["a"]), mod_b), mod_b))
        return F.struct(left.alias("a"), right.alias("b"))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _number(chars: Column, alphabet: str) -> Column:
    """The value of a string of at most 13 letters or 18 digits; of '' zero."""
    base = len(alphabet)
    return F.aggregate(
        F.filter(F.split(chars, ""), lambda c: c != ""),
        F.lit(0).cast("long"),
        lambda acc, c: acc * base + F.instr(F.lit(alphabet), c) - 1,
    )


def _power(base: int, n: Column) -> Column:
    return F.aggregate(F.array_repeat(F.lit(base), n), F.lit(1).cast("long"), lambda acc, b: acc * b)


def _string(value: Column, n: Column, alphabet: str) -> Column:
    """value as n characters of the alphabet, the inverse of _number()."""
    base = F.lit(len(alphabet)).cast("long")
    return F.aggregate(
        F.array_repeat(base, n),
        F.struct(value.alias("v"), F.lit("").alias("s")),
        lambda acc, b: F.struct(
            F.call_function("div", acc["v"], b).alias("v"),
            F.concat(F.substring(F.lit(alphabet), (F.pmod(acc["v"], b) + 1).cast("int"), F.lit(1)), acc["s"]).alias("s"),
        ),
        lambda acc: acc["s"],
    )


def permute_chars(chars: Column, alphabet: str, key: Column, tweak: Column, back: bool = False) -> Column:
    """A keyed permutation of the strings of one length over the alphabet.

    Strings are cut into blocks of 26 letters or 36 digits; each block's tweak names its place.
    """
    half = 13 if len(alphabet) > 10 else 18

    def block(i: Column) -> Column:
        part = F.substring(chars, (i * 2 * half + 1).cast("int"), F.lit(2 * half))
        n_a = F.floor(F.length(part) / 2).cast("int")
        n_b = F.length(part) - n_a
        named = F.concat_ws("#", tweak, i.cast("string"), F.length(chars).cast("string"))
        out = feistel(
            _number(F.substring(part, F.lit(1), n_a), alphabet),
            _number(F.substring(part, n_a + 1, n_b), alphabet),
            _power(len(alphabet), n_a),
            _power(len(alphabet), n_b),
            key,
            named,
            back,
        )
        return F.concat(_string(out["a"], n_a, alphabet), _string(out["b"], n_b, alphabet))

    last = F.floor((F.greatest(F.length(chars), F.lit(1)) - 1) / (2 * half)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), last), block), "")


def _only(value: Column, kind: str) -> Column:
    return F.regexp_replace(value, f"[^{kind}]", "")


def _refill(value: Column, kind: str, chars: Column, start: int = 0) -> Column:
    """value with its characters of a kind, from the start-th on, replaced by chars in order."""
    return F.array_join(
        F.transform(
            F.split(value, ""),
            lambda c, i: F.when(
                c.rlike(f"^[{kind}]$") & (F.length(_only(F.substring(value, F.lit(1), i + 1), kind)) > start),
                F.substring(chars, F.length(_only(F.substring(value, F.lit(1), i + 1), kind)) - start, F.lit(1)),
            ).otherwise(c),
        ),
        "",
    )


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """The Luhn sum; every second digit counts double, from place doubled_from_right (0: the last)."""
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda d, i: F.when(
                F.pmod(i, F.lit(2)) == doubled_from_right % 2,
                F.call_function("div", d.cast("int") * 2, F.lit(10)).cast("int") + F.pmod(d.cast("int") * 2, F.lit(10)),
            ).otherwise(d.cast("int")),
        ),
        F.lit(0),
        lambda acc, d: acc + d,
    )


def _card_good(value: Column) -> Column:
    return F.pmod(_luhn_sum(_only(value, "0-9"), 1), F.lit(10)) == 0


def _card(value: Column, key: Column, back: bool) -> Column:
    digits = _only(value, "0-9")
    body = permute_chars(F.substring(digits, F.lit(1), F.length(digits) - 1), DIGITS, key, F.lit("card"), back)
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(body, 0), F.lit(10)), F.lit(10)).cast("string")
    return F.when(_card_good(value), _refill(value, "0-9", F.concat(body, check))).otherwise(value)


def _mod97(value: Column) -> Column:
    """The remainder by 97 of digits and capital letters (A = 10)."""
    return F.aggregate(
        F.filter(F.split(value, ""), lambda c: c != ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), F.pmod(acc * 10 + F.instr(F.lit(DIGITS), c) - 1, F.lit(97))).otherwise(
            F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))
        ),
    )


def _iban_good(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    return (_mod97(turned) == 1) & F.length(plain).between(15, 34)


def _iban(value: Column, key: Column, back: bool) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    new = _refill(account, "0-9", permute_chars(_only(account, "0-9"), DIGITS, key, F.concat(F.lit("iban"), country), back))
    check = F.lpad((F.lit(98) - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    full = F.concat(country, check, new)
    return F.when(_iban_good(value), _refill(value, "A-Z0-9", full)).otherwise(value)


def _date(value: Column, key: Column, back: bool) -> Column:
    """One permutation of days for all formats, so that a date keeps one pseudonym in each of them.

    It stays among the days 1 to 12 of a month or among the others: a dd/MM/yyyy date that cannot be
    MM/dd/yyyy stays one.
    """
    radices = [F.lit(x).cast("long") for x in CYCLE_RADICES]
    start = F.lit(CYCLE_START).cast("date")

    def step(n: Column) -> Column:
        out = feistel(F.call_function("div", n, radices[1]), F.pmod(n, radices[1]), *radices, key, F.lit("date"), back)
        return out["a"] * radices[1] + out["b"]

    def late(n: Column) -> Column:
        return F.dayofmonth(F.date_add(start, n.cast("int"))) > 12

    def moved(form: str) -> tuple[Column, Column]:
        day = F.try_to_timestamp(value, F.lit(form)).cast("date")
        n = F.datediff(day, start).cast("long")
        good = day.isNotNull() & n.between(0, CYCLE_RADICES[0] * CYCLE_RADICES[1] - 1)
        to = F.aggregate(F.array_repeat(F.lit(0), WALK), step(n), lambda at, _: F.when(late(at) == late(n), at).otherwise(step(at)))
        return good, F.date_format(F.date_add(start, to.cast("int")), form)

    (iso, iso_new), (us, us_new), (dot, dot_new), (eu, eu_new) = map(moved, ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "dd/MM/yyyy"))
    out = F.when(value.rlike("-"), F.when(iso, iso_new)).when(value.contains("."), F.when(dot, dot_new))
    return F.coalesce(out.otherwise(F.when(us, us_new).when(eu, eu_new)), value)


def _ssn(value: Column, key: Column, back: bool) -> Column:
    area, group, serial = (F.substring(value, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    good = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    a = area - 1 - F.when(area > 666, 1).otherwise(0)
    out = feistel(a, (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, F.lit("ssn"), back)
    new_area = out["a"] + 1 + F.when(out["a"] >= 665, 1).otherwise(0)
    rest = F.call_function("div", out["b"], F.lit(9999).cast("long"))
    new = F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((new_area, 3), (rest + 1, 2), (F.pmod(out["b"], F.lit(9999)) + 1, 4))])
    return F.when(good, new).otherwise(value)


def _ip(value: Column, key: Column, back: bool) -> Column:
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    side = F.lit(65536).cast("long")
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], side, side, key, F.lit("ip"), back)
    high, low = (lambda x: F.call_function("div", x, F.lit(256).cast("long"))), (lambda x: F.pmod(x, F.lit(256)))
    return F.concat_ws(".", *[x.cast("string") for x in (high(out["a"]), low(out["a"]), high(out["b"]), low(out["b"]))])


def _phone(value: Column, key: Column, back: bool) -> Column:
    code = F.regexp_extract(value, r"^\+([0-9]{1,3})[ .\-(]", 1)
    code = F.when(value.startswith("+") & (code == ""), F.substring(value, 2, 1)).otherwise(code)
    digits = F.substring(_only(value, "0-9"), F.length(code) + 1, F.lit(20))
    new = F.concat(code, permute_chars(digits, DIGITS, key, F.concat(F.lit("phone"), code), back))
    return F.when(F.length(_only(value, "0-9")).between(7, 15), _refill(value, "0-9", new)).otherwise(value)


def _email(value: Column, key: Column, back: bool) -> Column:
    local = F.lower(F.substring_index(value, "@", 1))
    letters, digits = _only(local, "a-z"), _only(local, "0-9")
    shape = F.concat(F.lit("email"), F.lower(F.substring_index(value, "@", -1)))
    turned = F.when(letters != "", _refill(local, "a-z", permute_chars(letters, LETTERS, key, shape, back))).otherwise(local)
    turned = F.when(digits != "", _refill(turned, "0-9", permute_chars(digits, DIGITS, key, shape, back))).otherwise(turned)
    return F.concat(turned, F.lit("@"), F.substring_index(value, "@", -1))


_MAKERS = {"iban": _iban, "email": _email, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: Column, back: bool = False) -> Column:
    """The pseudonym of one found value; the value itself if it fails its kind's validation.

    back: the value of a pseudonym (an e-mail's comes back in lower case).
    """
    out = F.lit(None).cast("string")
    for kind in reversed(list(PATTERNS)):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), _MAKERS[kind](value, key, back)).otherwise(out)
    return F.coalesce(out, value)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _readings(run: Column) -> Column:
    """A run of groups as pieces in order: 'x' and a group, or a letter and the groups of one IBAN or card.

    From the left, each group that can start a valid reading takes the longest one that ends at a
    border of groups; the next piece begins behind it. Letters before the later groups of a piece
    have no meaning.
    """

    def valid(value: Column) -> Column:
        card = value.rlike(f"^(?:{PATTERNS['card']})$")
        return F.when(value.rlike(f"^(?:{PATTERNS['iban']})$"), _iban_good(value)).when(card, _card_good(value)).otherwise(F.lit(False))

    def longest(ahead: Column) -> Column:
        ends = F.sequence(F.lit(1), F.size(ahead))
        return F.array_max(F.filter(ends, lambda n: _let(F.array_join(F.slice(ahead, F.lit(1), n), " "), valid)))

    def letter(groups: Column, group: Column, i: Column) -> Column:
        n = F.when(group.rlike("^(?:[0-9]|[A-Z]{2}[0-9]{2})"), _let(F.slice(groups, i + 1, F.lit(MOST_GROUPS)), longest))
        return _let(n, lambda n: F.when(n.isNull(), F.lit("x")).otherwise(F.substring(F.lit(_LETTERS), n, F.lit(1))))

    marked = _let(F.split(run, " "), lambda groups: F.array_join(F.transform(groups, lambda g, i: F.concat(letter(groups, g, i), g)), " "))
    return F.regexp_extract_all(marked, F.lit(_PIECES), F.lit(0))


def _replaced(match: Column, key: Column, back: bool) -> Column:
    """What a match becomes: its new text, the values found in it and those replaced."""

    def of_piece(piece: Column) -> Column:
        old = F.regexp_replace(piece, "[a-z]", "")
        new = F.when(piece.startswith("x"), old).when(old.rlike("^[A-Z]"), _iban(old, key, back)).otherwise(_card(old, key, back))
        return F.struct(new.alias("text"), (~piece.startswith("x")).cast("int").alias("found"), (new != old).cast("int").alias("moved"))

    def total(pieces: Column, name: str) -> Column:
        return F.aggregate(pieces, F.lit(0), lambda n, p: n + p[name])

    def of_run(pieces: Column) -> Column:
        text = F.array_join(F.transform(pieces, lambda p: p["text"]), " ")
        return F.struct(text.alias("text"), F.greatest(F.lit(1), total(pieces, "found")).alias("found"), total(pieces, "moved").alias("moved"))

    def of_value(new: Column) -> Column:
        return F.struct(new.alias("text"), F.lit(1).alias("found"), (new != match).cast("int").alias("moved"))

    run = _let(F.transform(_readings(match), of_piece), of_run)
    return F.when(match.rlike(_IS_RUN), run).otherwise(_let(pseudonym(match, key, back), of_value))


def pseudonymise(docs: DataFrame, key: str | Column, back: bool = False) -> DataFrame:
    """docs with its text's personal values replaced, plus n_found (matches) and n_replaced.

    Card numbers (Luhn), IBANs (mod 97), dates of 1800-2199, US social security numbers, IPv4
    addresses, phone numbers and the local parts of e-mail addresses are permuted under the key
    inside their format: length, separators, country and check digits stay valid, so equal values
    stay equal in every document and different ones different. Values that fail validation stay.
    Values may stand side by side: a phone number ends where another value starts, and runs of
    groups are cut into the IBANs and cards whose check digits hold, longest first from the left;
    a run without any counts as one match. back can cut a run elsewhere, if a pseudonym's digits
    happen to complete a longer valid reading with the groups beside it.
    A date has one pseudonym in all formats; nn/nn/yyyy is read as MM/dd/yyyy where it can be.

    Null text stays null with counts 0, empty text stays empty; whole texts are scanned. Repeated
    rows keep their rows. Columns of docs named n_found or n_replaced are replaced, all others stay.

    One map over the rows without a shuffle: matches and the gaps between them come from one
    pattern, and only rows with a digit or an @ are matched at all.
    """
    key = F.lit(key) if isinstance(key, str) else key
    names = ("n_found", "n_replaced")
    others = [c for c in docs.columns if c not in ("text", *names)]
    row = packed(docs.select(*[f"`{c}`" for c in others])) if others else F.lit(None).alias("row")
    values = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    found = docs.select(row.alias("row"), "text", values.alias("old")).withColumn("new", F.transform("old", lambda m: _replaced(m, key, back)))
    gaps = F.split("text", ANY, -1)
    filled = F.array_join(F.zip_with(gaps, "new", lambda gap, value: F.concat(gap, F.coalesce(value["text"], F.lit("")))), "")

    def total(name: str) -> Column:
        return F.aggregate("new", F.lit(0).cast("long"), lambda n, m: n + m[name])

    return found.select(
        *[F.col(f"row.`{c}`") for c in others],
        F.when(F.size("old") > 0, filled).otherwise(F.col("text")).alias("text"),
        F.coalesce(total("found"), F.lit(0)).cast("long").alias("n_found"),
        F.coalesce(total("moved"), F.lit(0)).cast("long").alias("n_replaced"),
    )


#: The query's key. Callers pass a secret of their own.
DEMO_KEY = "pseudonym key of the demonstration query"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
