"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation in SQL expressions.

Validated values are permuted within their own format: a card number stays a
number of that length with a right check digit and the same separators, a
date stays a date in its notation, an address of four bytes stays one.  The
permutation depends on the key and the kind of value alone, so equal values
get equal pseudonyms in every document, and different values different ones.

A value is split into (x, y) over Z_a x Z_b with a * b the number of values
of its format; rounds add a keyed hash of one part to the other, modulo its
size.  Each round can be undone, so the whole is a bijection of the format
without any walking along cycles.  All of it is DataFrame functions.

Kinds: e-mail addresses (the whole address gives a keyed name at a reserved
domain), telephone numbers (national digits, by country), card numbers (13 to 19 digits
passing the Luhn check), social security numbers with valid groups, IPv4
addresses, and dates from 1800 to 2199 (2024-05-31, 31.05.2024, 31/05/2024,
and 05/31/2024 where the former is no date).  What looks alike but fails its
validation stays as it is.  Telephone numbers and dates are permuted as values, not
as texts: one number or day has one pseudonym in all its notations, and each is
written in the notation of its place.

Defined results: a null text stays null, an empty one empty; repeated rows,
null ids and other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contingo.llm.cluster import free_name

ROUNDS = 8
#: (kind, pattern), in the order in which they are tried at a place of the text.
KINDS = (
    ("email", r"[A-Za-z0-9_%+\-À-ɏ](?:[A-Za-z0-9._%+\-À-ɏ]{0,63})@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}"),
    ("date", r"(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d\-/]|\.\d)"),
    ("ip", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}"
              r"|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)"),
    ("card", r"(?<!\d)(?:\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{13,19})(?!\d)"),
)
#: Country calling codes of one and two digits; all others have three.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d)"
PATTERN = "|".join(p for _, p in KINDS)
#: 146,097 days are 400 years; 189 * 773.
FIRST_DAY, DAYS_X, DAYS_Y = "1800-01-01", 189, 773


def keyed(key: str, tag: Column | str, *parts: Column) -> Column:
    """A non-negative 60-bit keyed hash."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    said = F.concat_ws("|", F.lit(key), tag, *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(F.concat(F.lit(key), F.sha2(said, 256)), 256), 1, 15), 16, 10).cast("long")


def permuted(x: Column, y: Column, size_x: Column, size_y: Column, key: str, tag: Column | str) -> Column:
    """(x, y) after a keyed permutation of Z_size_x x Z_size_y."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda s, r: F.when(r % 2 == 1, F.struct(((s["x"] + keyed(key, tag, r, s["y"])) % size_x).alias("x"),
                                                 s["y"].alias("y")))
        .otherwise(F.struct(s["x"].alias("x"), ((s["y"] + keyed(key, tag, r, s["x"])) % size_y).alias("y"))))


def power_of_ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n.cast("int") + 1, F.lit("0")).cast("long")


def permuted_digits(digits: Column, key: str, kind: Column | str) -> Column:
    """A digit string of 2 to 36 digits for one of the same length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    out = permuted(digits.substr(F.lit(1), half), digits.substr(half + 1, n - half),
                   power_of_ten(half), power_of_ten(n - half), key,
                   F.concat(F.lit(kind) if isinstance(kind, str) else kind, n.cast("string")))
    text = F.transform(F.array(out), lambda s: F.concat(F.lpad(s["x"].cast("string"), half, F.lit("0")),
                                                        F.lpad(s["y"].cast("string"), n - half, F.lit("0"))))
    return text[0]


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def put_digits(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced, in order, by the given ones."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(shape)), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, i: F.when(shape.substr(i, F.lit(1)).rlike("[0-9]"),
                            F.struct(F.concat(s["out"], digits.substr(s["at"], F.lit(1))).alias("out"),
                                     (s["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(s["out"], shape.substr(i, F.lit(1))).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Every second digit from the right counts double, 9 taken off above 9."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + worth(i))


def card_pseudonym(value: Column, key: str) -> Column:
    digits = only_digits(value)
    body = F.transform(F.array(digits.substr(F.lit(1), F.length(digits) - 1)),
                       lambda d: permuted_digits(d, key, "card"))
    new = F.transform(body, lambda b: put_digits(
        value, F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))))
    return F.when(luhn_sum(digits) % 10 == 0, new[0])


def phone_pseudonym(value: Column, key: str) -> Column:
    """The country code stays, the national digits are permuted among those of the same country and length, so a
    number keeps its pseudonym however it is written. A number without a code is of country 1. A number with a code
    has 7 to 15 digits in all."""
    digits = only_digits(value)
    abroad = value.startswith("+")
    code = F.when(abroad, F.regexp_extract(digits, COUNTRY, 0)).otherwise(F.lit(""))
    national = digits.substr(F.length(code) + 1, F.length(digits))
    kind = F.concat(F.lit("phone|"), F.when(abroad, code).otherwise(F.lit("1")), F.lit("|"))
    fits = ~abroad | (code != "") & F.length(digits).between(7, 15) & (F.length(national) >= 4)
    return F.when(fits, put_digits(value, F.concat(code, permuted_digits(national, key, kind))))


def ip_pseudonym(value: Column, key: str) -> Column:
    part = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    new = F.transform(F.array(permuted(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536),
                                       key, "ip")),
                      lambda s: F.concat_ws(".", F.floor(s["x"] / 256).cast("string"), (s["x"] % 256).cast("string"),
                                            F.floor(s["y"] / 256).cast("string"), (s["y"] % 256).cast("string")))
    return F.when(F.forall(part, lambda p: p <= 255), new[0])


def ssn_pseudonym(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (value.substr(a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    new = F.transform(F.array(permuted(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")),
                      lambda s: F.struct(F.floor(s["x"] / 99).alias("r"), (s["x"] % 99 + 1).alias("g"),
                                         (s["y"] + 1).alias("s")))
    text = F.transform(new, lambda n: F.concat_ws(
        "-", F.lpad((n["r"] + 1 + F.when(n["r"] + 1 >= 666, 1).otherwise(0)).cast("string"), 3, "0"),
        F.lpad(n["g"].cast("string"), 2, "0"), F.lpad(n["s"].cast("string"), 4, "0")))
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), text[0])


def date_pseudonym(value: Column, key: str) -> Column:
    def one(form: str, written: str, tag: str) -> Column:
        day = F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        fits = value.rlike(written) & day.between(0, DAYS_X * DAYS_Y - 1)
        new = F.transform(F.array(permuted(F.floor(day / DAYS_Y), day % DAYS_Y, F.lit(DAYS_X), F.lit(DAYS_Y), key, tag)),
                          lambda s: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"),
                                                             (s["x"] * DAYS_Y + s["y"]).cast("int")), form))
        return F.when(fits, new[0])

    return F.coalesce(one("yyyy-MM-dd", r"^\d{4}-", "date"), one("dd.MM.yyyy", r"^\d\d\.", "date"),
                      one("dd/MM/yyyy", "^../", "date"), one("MM/dd/yyyy", "^../", "date"))


def email_pseudonym(value: Column, key: str) -> Column:
    name = F.substring(F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key + "|email|"), F.lower(value)), 256)), 256),
                       1, 16)
    return F.concat(F.lit("u"), name, F.lit("@example.invalid"))


MAKERS = {"email": email_pseudonym, "date": date_pseudonym, "ip": ip_pseudonym, "ssn": ssn_pseudonym,
          "phone": phone_pseudonym, "card": card_pseudonym}


def pseudonym(value: Column, key: str) -> Column:
    """(kind, new) of a candidate; both null if it fails its kind's validation."""
    def made(kind: str) -> Column:
        return F.transform(F.array(MAKERS[kind](value, key)), lambda n: F.when(
            n.isNotNull(), F.struct(F.lit(kind).alias("kind"), n.alias("new"))))[0]

    found = F.lit(None).cast("struct<kind:string,new:string>")
    for kind, pattern in reversed(KINDS):
        found = F.when(value.rlike(f"^(?:{pattern})$"), made(kind)).otherwise(found)
    return found


def find_and_replace(docs: DataFrame, key: str, text: str = "text", found: str = "pii_found") -> DataFrame:
    """The documents with pseudonyms in their texts, and a column ``found``: (kind, new) of each, in order. A
    column of that name is replaced."""
    docs = docs.drop(found)
    values = free_name(docs.columns, "pii_values")
    candidate = F.col(text).rlike("[0-9]") | F.col(text).contains("@")
    rows = docs.withColumn(values, F.when(candidate, F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))))
    rows = rows.withColumn(found, F.transform(values, lambda v: pseudonym(v, key)))
    between = F.split(F.col(text), PATTERN, -1)
    instead = F.zip_with(F.col(found), F.col(values), lambda f, v: F.coalesce(f["new"], v))
    new = F.when(F.size(F.filter(found, lambda f: f.isNotNull())) > 0,
                 F.array_join(F.zip_with(between, instead, lambda b, i: F.concat(b, F.coalesce(i, F.lit("")))), "")) \
        .otherwise(F.col(text))
    return rows.withColumn(text, new).withColumn(found, F.filter(found, lambda f: f.isNotNull())).drop(values)


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with pseudonyms in their texts; columns as before."""
    found = free_name(docs.columns, "pii_found")
    return find_and_replace(docs, key, text, found).drop(found)


def pseudonym_key(spark) -> str:
    """The secret key in spark.contingo.pseudonym.key; the default is for tests."""
    return spark.conf.get("spark.contingo.pseudonym.key", "for tests only")


def op5_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_and_replace(docs, pseudonym_key(spark))

    def count(kind: str | None) -> Column:
        own = F.filter("pii_found", lambda f: F.lit(True) if kind is None else f["kind"] == kind)
        return F.when(F.col("pii_found").isNull(), 0).otherwise(F.size(own)).cast("long")

    return out.select("doc_id", "text", count(None).alias("n_found"), *(count(k).alias(f"n_{k}") for k, _ in KINDS))
