import hashlib
import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from quillbit.llm import pii_feistel as P


def permute(value, a_size, b_size, tweak, key=P.KEY):
    a, b = divmod(value, b_size)
    for i in range(1, P.ROUNDS + 1):
        mix = int(hashlib.sha256(f"{key}|{tweak}|{i}|{b if i % 2 else a}".encode()).hexdigest()[:15], 16)
        if i % 2:
            a = (a + mix) % a_size
        else:
            b = (b + mix) % b_size
    return a * b_size + b


def luhn(digits):
    d = [int(x) for x in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def plain_card(digits):
    n = len(digits) - 1
    to = permute(int(digits[:-1]), 10 ** (n // 2), 10 ** (n - n // 2), f"card:{len(digits)}")
    body = f"{to:0{n}d}"
    return body + next(str(c) for c in range(10) if luhn(body + str(c)))


def rewrite(spark, texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in P.pseudonymize(docs, **kw).orderBy("doc_id").collect()]


def test_feistel_is_a_bijection_and_as_defined(spark):
    rows = spark.range(17 * 43).select("id", P.feistel(F.col("id"), F.lit(17).cast("bigint"), F.lit(43).cast("bigint"), F.lit("t"), "k").alias("to")).collect()
    assert sorted(r.to for r in rows) == list(range(17 * 43))
    assert all(r.to == permute(r.id, 17, 43, "t", "k") for r in rows)
    big = [0, 1, 10**18 - 1, 987654321987654321]
    rows = spark.createDataFrame([(v,) for v in big], "v long").select("v", P.feistel(F.col("v"), F.lit(10**9), F.lit(10**9), F.lit("t"), "k").alias("to")).collect()
    assert all(r.to == permute(r.v, 10**9, 10**9, "t", "k") for r in rows)


def test_kinds_against_a_plain_version(spark):
    r = random.Random(1)
    cards = []
    while len(cards) < 40:
        c = "".join(r.choices("0123456789", k=r.randrange(13, 20)))
        if luhn(c):
            cards.append(c)
    assert rewrite(spark, cards) == [plain_card(c) for c in cards]
    phones = [f"+1 ({r.randrange(1000):03d}) 555-{r.randrange(10000):04d}" for _ in range(20)]
    for old, new in zip(phones, rewrite(spark, phones), strict=True):
        own, other = (re.sub("[^0-9]", "", x) for x in (old, new))
        assert other == own[0] + f"{permute(int(own[1:]), 10**5, 10**5, 'phone:10'):010d}" and re.sub("[0-9]", "9", old) == re.sub("[0-9]", "9", new)
    ips = [".".join(str(r.randrange(256)) for _ in range(4)) for _ in range(20)]
    number = lambda ip: sum(int(x) << s for x, s in zip(ip.split("."), (24, 16, 8, 0), strict=True))
    assert [number(x) for x in rewrite(spark, ips)] == [permute(number(x), 65536, 65536, "ip") for x in ips]
    start = date(1900, 1, 1)
    days = [start, date(2099, 12, 31), date(2000, 2, 29), *[start + timedelta(r.randrange(73049)) for _ in range(20)]]
    moved = [start + timedelta(permute((d - start).days, 17, 4297, "date")) for d in days]
    for form in ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%m/%d/%Y"):
        assert rewrite(spark, [d.strftime(form) for d in days]) == [d.strftime(form) for d in moved]
    ssns = ["001-01-0001", "665-99-9999", "667-01-0001", "899-99-9999", "123-45-6789"]
    out = rewrite(spark, ssns)
    assert len(set(out)) == 5 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in out)


def test_links_and_decoys(spark):
    out = rewrite(spark, ["a 4539148803436467 b", "4539 1488 0343 6467", "und.34@mail7.example.com!!", "UND.34@MAIL7.EXAMPLE.COM"])
    assert out[0].split()[1] == out[1].replace(" ", "") and out[2] == out[3] + "!!" and "und.34" not in out[2]
    clean = ["4539148803436468", "999.1.1.1", "2023-02-30", "31.11.2020", "000-12-3456", "666-12-3456", "v1.2.3", "1.2.3.4.5", "deadbeef4539148803436467cafe", "a@b", "12:30 100% 3.14", "1899-12-31", "", "@", "no digits"]
    assert rewrite(spark, clean) == clean
    assert rewrite(spark, ["4539148803436467"], key="other") != rewrite(spark, ["4539148803436467"])


def test_edges(spark):
    long = "x" * 300_000 + " 192.0.2.1 " + "7" * 300_000 + " " + "a.b-" * 50_000
    rows = [(1, None, 4), (2, "", 4), (3, long, 4), (None, "192.0.2.1 $1 \\ 192.0.2.1", 4), (None, "192.0.2.1 $1 \\ 192.0.2.1", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_ip int")
    found = P.pseudonymize(docs, counts=True).collect()
    assert len(found) == 5 and [f.n_ip for f in found] == [0, 0, 1, 2, 2]
    new = found[3].text.split(" ")[0]
    assert found[3].text == f"{new} $1 \\ {new}" and found[2].text == long.replace("192.0.2.1", new) and found[0].text is None
    assert P.pseudonymize(docs).columns == docs.columns and P.pseudonymize(docs.limit(0)).count() == 0


def test_query_is_native_and_leaves_clean_texts(spark, tables):
    out = P.query(spark, tables)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    changed = 0
    for r in out.collect():
        hits = sum(r[f"n_{k}"] for k in P.KINDS)
        assert (r.text != before[r.doc_id]) == (hits > 0)
        changed += hits > 0
        assert not re.search(r"\(\d{3}\) 555-\d{4}|@mail\d", r.text) or hits
    assert changed > 0


def test_national_formats_and_their_decoys(spark):
    """Day-first dates, cards of 4-6-5 digits, and national phone numbers keep their
    forms; look-alikes stay."""
    import datetime
    import re

    late = [f"{d:02d}/{m:02d}/{y}" for y in (1900, 1990, 2099) for m in range(1, 13) for d in range(13, 32) if d <= (datetime.date(y + m // 12, m % 12 + 1, 1) - datetime.timedelta(1)).day]
    out = rewrite(spark, late)
    assert len(set(out)) == len(late) and out != late
    for new in out:
        d, m, y = map(int, new.split("/"))
        assert d > 12 and 1900 <= y <= 2099 and datetime.date(y, m, d)
    leap = [f"29/02/{y}" for y in range(1904, 2100, 4)]
    assert sorted(rewrite(spark, leap)) == leap and rewrite(spark, leap) != leap
    for old in ("3782 822463 10005", "3782-822463-10005"):
        new = rewrite(spark, [old])[0]
        assert new != old and re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", old)
    for old in ("06 12 34 56 78", "06.12.34.56.78", "030 1234567", "0221/123456"):
        new = rewrite(spark, [f"call {old}, please"])[0]
        assert new != f"call {old}, please" and re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", f"call {old}, please")
        prefix = 2 if old[2] in " ." else len(re.split("[ /]", old)[0])
        assert new[5 : 5 + prefix] == old[:prefix]
    clean = ["13/13/1990", "31/04/2001", "29/02/1901", "32/01/2000", "3782 822463 10006", "00 12 34 56 78", "06 12 34 56 7", "1030 1234567", "v030 1234567", "06 12 34 56 78 90", "5551234567"]
    assert rewrite(spark, clean) == clean
