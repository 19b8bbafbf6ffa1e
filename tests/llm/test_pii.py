import re

from pyspark.sql import functions as F

from contingo.llm import pii
from tests.llm.conftest import CLASHES, EDGE_IDS, EDGE_TEXTS


def luhn(s):
    d = [int(c) for c in s[::-1] if c.isdigit()]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def replaced(make_docs, texts, key="k"):
    return {r.doc_id: r.text for r in pii.find_and_replace(make_docs(texts), key).collect()}


def test_formats_stay_valid(make_docs):
    texts = ["4111 1111 1111 1111", "7536784127813050!!", "1234567812345678", "97.51.17.173$$$", "999.1.1.1",
             "+1 (017) 555-7713", "123-45-6789", "000-12-3456", "1987-02-28", "28.02.1987", "31/12/1999", "12/31/1999", "2020-13-45",
             "und.34@mail7.example.com###", "7536784127813050 4845168114407329", "no data 12 34", "1.2.3", "378282246310005"]
    got = replaced(make_docs, texts)
    same = {2, 4, 7, 12, 15, 16}
    for i, t in enumerate(texts):
        assert (got[i] == t) == (i in same), (t, got[i])
        if "@" not in t:
            assert re.sub(r"\d+" if "." in t and t.count(".") == 3 else r"\d", "0", got[i]) \
                == re.sub(r"\d+" if "." in t and t.count(".") == 3 else r"\d", "0", t)
    assert luhn(got[0]) and luhn(got[1][:16]) and luhn(got[14][:16]) and luhn(got[14][17:]) and luhn(got[17])
    assert all(int(x) < 256 for x in re.findall(r"\d+", got[3]))
    assert re.fullmatch(r"u[0-9a-f]{16}@example\.invalid###", got[13])


def test_equal_values_stay_linked_and_keys_differ(make_docs):
    texts = ["card 7536784127813050 here", "again 7536784127813050.", "ip 10.1.2.3", "10.1.2.3 ip"]
    a, b = replaced(make_docs, texts), replaced(make_docs, texts, "other")
    assert a[0].split()[1] == a[1].split()[1].rstrip(".") and a[2].split()[1] == a[3].split()[0]
    assert a[0] != b[0] and a[2] != b[2]


def test_permutations_are_bijections(spark):
    small = spark.range(7 * 11).select(pii.permuted(F.col("id") % 7, F.floor(F.col("id") / 7), F.lit(7), F.lit(11), "k", "t").alias("p"))
    assert small.distinct().count() == 77
    digits = spark.range(1000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "d").alias("d"))
    assert {r.d for r in digits.collect()} == {f"{i:03d}" for i in range(1000)}
    days = spark.sql("select date_format(date_add(date'1990-01-01', cast(id as int)), 'dd.MM.yyyy') d from range(2000)")
    assert days.select(pii.date_pseudonym(F.col("d"), "k")).distinct().count() == 2000
    ssn = spark.sql("select concat('665-', lpad(cast(id + 1 as string), 2, '0'), '-0001') s from range(99) union all "
                    "select concat('667-', lpad(cast(id + 1 as string), 2, '0'), '-0001') s from range(99)")
    out = [r[0] for r in ssn.select(pii.ssn_pseudonym(F.col("s"), "k")).collect()]
    assert len(set(out)) == 198 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", s) for s in out)


def test_edges_and_native_plan(make_docs):
    docs = make_docs(EDGE_TEXTS, EDGE_IDS, **CLASHES)
    out = pii.pseudonymize(docs, "k")
    assert out.columns == docs.columns
    assert sorted(str(r.text) for r in out.collect()) == sorted(map(str, EDGE_TEXTS))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert pii.pseudonymize(make_docs([]), "k").count() == 0


def test_counts(make_docs, spark):
    found = pii.find_and_replace(make_docs(["a@b.example 10.0.0.1 10.0.0.2"]), "k").collect()[0].pii_found
    assert [f.kind for f in found] == ["email", "ip", "ip"]


def test_one_number_or_day_in_any_notation(make_docs):
    texts = ["+49 170 1234567", "+491701234567", "+49-170 1234567", "+44 170 1234567", "+1 (212) 555-7713", "(212) 555-7713",
             "212-555-7713", "212.555.7714", "+0 170 1234567", "1999-12-31", "31.12.1999", "31/12/1999", "12/31/1999"]
    got = replaced(make_docs, texts)
    digits = [re.sub(r"\D", "", got[i]) for i in range(len(texts))]
    assert digits[0] == digits[1] == digits[2] and digits[0].startswith("49") and digits[0] != "491701234567"
    assert digits[3].startswith("44") and digits[3][2:] != digits[0][2:]
    assert digits[4] == "1" + digits[5] and digits[5] == digits[6] != digits[7]
    assert got[8] == texts[8]
    for i, t in enumerate(texts[:8]):
        assert re.sub(r"\d", "0", got[i]) == re.sub(r"\d", "0", t)
    y, m, d = got[9].split("-")
    assert (got[10], got[11], got[12]) == (f"{d}.{m}.{y}", f"{d}/{m}/{y}", f"{m}/{d}/{y}")


def test_national_numbers_stay_different(spark):
    rows = spark.sql("select concat('+4917', lpad(cast(id as string), 7, '0')) p from range(3000)")
    out = [r[0] for r in rows.select(pii.phone_pseudonym(F.col("p"), "k")).collect()]
    assert len(set(out)) == 3000 and all(re.fullmatch(r"\+49\d{9}", p) for p in out)
